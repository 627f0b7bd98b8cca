"""What the search for links holds at once: executors share their memory between two workers and the JVM."""

import tracemalloc

import numpy as np

from lamella.llm import simhash


def test_near_copies_in_many_groups_take_bounded_memory():
    rng = np.random.default_rng(1)
    groups, size, most_bits = 30, 2048, 39
    base = rng.integers(0, 1 << 63, size=(groups, 4), dtype=np.uint64)
    fps = np.repeat(base, size, axis=0)
    for _ in range(12):  # any two of a group differ in 24 bits at most
        p = rng.integers(0, 256, len(fps))
        fps[np.arange(len(fps)), p // 64] ^= np.uint64(1) << (p % 64).astype(np.uint64)
    group = np.repeat(np.arange(groups), size)
    tracemalloc.start()
    try:
        nodes, roots = simhash.linked(group, np.arange(len(fps)), fps, most_bits)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    root = np.arange(len(fps))
    root[nodes] = roots
    assert len(np.unique(root)) == groups and (group[root] == group).all()
    assert peak < 100e6
