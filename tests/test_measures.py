"""Measurements against goldens and small brute force."""

from __future__ import annotations

import itertools
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions import geometry
from lamella.model import Axis, InvalidImage, anisotropy, element_size, is_isotropic, spatial_unit, subspace_label, unit_header, validate
from lamella.operators import components, distance, ellipsoids, filters, fits, fraction, fractal, mesh, mil, particles, skeleton, topology
from lamella.plans import registry
from lamella.results import Results, pivoted
from lamella.sources import raw
from lamella.streaming import fraction as streaming

SF = "/root/testdata/sf0.001"
MM = [Axis(k, 7, 0.9, "mm") for k in "XYZ"]


def volume(spark, points, c: int = 0):
    return spark.createDataFrame([(c, *map(int, p)) for p in points], "c int, x int, y int, z int")


def cube(low: int, high: int):
    return list(itertools.product(range(low, high + 1), repeat=3))


def frame(w: int, h: int, d: int):
    """The edges of a box, one voxel thick."""
    ends = lambda v, n: v in (0, n - 1)
    return [(x + 8, y + 8, z + 8) for x in range(w) for y in range(h) for z in range(d) if ends(x, w) + ends(y, h) + ends(z, d) >= 2]


# ---- model and results
def test_axes_and_units():
    assert math.isclose(element_size(MM), 0.9**3) and unit_header(MM) == "(mm³)" and spatial_unit(MM) == "mm"
    mixed = [Axis("X", 1, 1.0, "mm"), Axis("Y", 1, 1000.0, "µm")]
    assert math.isclose(element_size(mixed), 1.0)
    assert spatial_unit([Axis("X", unit="mm"), Axis("Y", unit="kg")]) is None and spatial_unit([Axis("X"), Axis("Y")]) == ""
    assert math.isnan(element_size([Axis("X", unit="mm"), Axis("Y")])) and math.isnan(element_size([Axis("X", linear=False)]))
    assert anisotropy([Axis("X", scale=1.0), Axis("Y", scale=1.1)]) == pytest.approx(0.1) and is_isotropic(MM)
    assert subspace_label("img", 0, 1) == "img Channel: 1, Time: 2"
    with pytest.raises(InvalidImage):
        validate(MM[:2], 3)
    with pytest.raises(ValueError):
        is_isotropic(MM, -1)


def test_results_fold(spark):
    r = Results()
    rows = [("B", "h2", 2.0), ("A", "h1", 1.0), ("A", "h1", 1.0), ("A", "h2", 2.0), ("A", "h2", 3.0)]
    for x in rows:
        r.add(*x)
    assert [(t["label"], t["h1"], t["h2"]) for t in r.table()] == [("B", None, 2.0), ("A", 1.0, 3.0), ("A", 1.0, 2.0)]
    with pytest.raises(ValueError):
        r.add("", "h", 1.0)
    with pytest.raises(TypeError):
        r.add("A", "h", None)
    long = spark.createDataFrame([("A", 0, "h1", 1.0), ("A", 1, "h2", 2.0), ("A", 2, "h1", 3.0)], "label string, seq bigint, header string, value double")
    assert sorted(map(tuple, pivoted(long, ["h1", "h2"]).collect())) == [("A", 1, 1.0, 2.0), ("A", 2, 3.0, None)]


def test_element_fraction_of_a_hyperstack(spark):
    on = {(0, 0), (1, 1)}
    rows = [(t, c, z, y, x, 255 if (t, c) in on and all(1 <= v <= 5 for v in (x, y, z)) else 0) for t in (0, 1) for c in (0, 1) for z in range(7) for y in range(7) for x in range(7)]
    found = fraction.of_image(spark.createDataFrame(rows, "t int, c int, z int, y int, x int, value int"), "img", MM).collect()
    assert [r["bv"] for r in found] == pytest.approx([125 * 0.9**3, 0, 0, 125 * 0.9**3]) and found[0]["tv"] == pytest.approx(343 * 0.9**3)
    assert fraction.headers(MM) == ("BV (mm³)", "TV (mm³)", "BV/TV")
    bad = spark.createDataFrame([(0, 0, 0, 0, 0, 7)], "t int, c int, z int, y int, x int, value int")
    with pytest.raises(Exception, match="mask"):
        fraction.of_image(bad, "img", MM).collect()


# ---- topology
def test_euler_of_frames(spark):
    for shape in ((6, 6, 6), (5, 7, 9)):
        assert topology.euler(volume(spark, frame(*shape)), ["c"]).first()["chi"] == -4
    found = topology.connectivity(volume(spark, frame(6, 7, 8)), ["c"], (24, 24, 24), (0.2, 0.2, 0.2)).first()
    assert found["connectivity"] == 5 and found["conn_density"] == pytest.approx(5 / (24**3 * 0.008))
    solid = topology.connectivity(volume(spark, cube(0, 3)), ["c"], (4, 4, 4)).first()
    # eight corners; a frame of twelve edges between them; a closed surface
    assert (solid["chi"], solid["chi0"], solid["chi1"], solid["chi2"], solid["delta_chi"]) == (1, 8, 8 - 12, 2, 1 - (2 / 2 - 4 / 4 + 8 / 8))


def test_outline(spark):
    assert topology.outline(volume(spark, cube(0, 4)), ["c"]).count() == 125 - 27
    assert topology.outline(volume(spark, cube(0, 4)), ["c"], (5, 5, 5)).count() == 0


# ---- fractal and mesh
def test_fractal_cube(spark):
    fg = volume(spark, cube(1, 2))
    assert fractal.box_sizes(4, 1, 2.0) == [4, 2, 1]
    counts = {r["size"]: r["n"] for r in fractal.box_counts(fg, ["c"], [4, 2, 1]).collect()}
    assert counts == {4: 1, 2: 8, 1: 8}
    found = fractal.fractal_dimension(fractal.box_counts(fg, ["c"], [4, 2, 1]), ["c"]).first()
    assert found["dimension"] == pytest.approx(1.5) and found["r2"] == pytest.approx(0.75)


def test_surface_of_a_cube(spark):
    fg = volume(spark, cube(1, 3))
    found = mesh.surface(fg, ["c"], (0.1, 0.1, 0.1)).first()
    assert found["area"] == pytest.approx(0.24) and found["volume"] == pytest.approx(8e-3)
    part = mesh.surface_fraction(fg, ["c"], (5, 5, 5), (0.25,) * 3).first()
    assert part["bv"] == pytest.approx(8 * 0.25**3) and part["tv"] == pytest.approx(64 * 0.25**3)
    triangles = mesh.mesh(fg, ["c"])
    assert mesh.mesh_area(triangles, ["c"]).first()["area"] == pytest.approx(24) and mesh.mesh_volume(triangles, ["c"]).first()["volume"] == pytest.approx(8)


# ---- components and particles
def test_components_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(1)
    points = [p for p in cube(0, 11) if rng.random() < 0.12]
    fg = volume(spark, points)
    found = [sorted(map(tuple, components.connected_components(fg, ["c"], n, block=b).collect())) for n in (26, 6) for b in (4, 64)]
    assert found[0] == found[1] and found[2] == found[3] and len({r[-1] for r in found[0]}) < len({r[-1] for r in found[2]})


def test_purify_fills_and_drops(spark):
    shell = [p for p in cube(2, 6) if any(v in (2, 6) for v in p)]
    fg = volume(spark, [*shell, (0, 0, 0)])
    assert {tuple(r)[1:] for r in components.purify(fg, ["c"], (9, 9, 9)).collect()} == set(cube(2, 6))


def test_particles(spark):
    shell = [p for p in cube(2, 6) if any(v in (2, 6) for v in p)]
    ring = [(x, y, 12) for x in range(10, 13) for y in range(10, 13) if (x, y) != (11, 11)]
    labels = components.connected_components(volume(spark, shell + ring), ["c"])
    found = {r["size"]: r for r in particles.analyse(volume(spark, shell + ring), ["c"]).collect()}
    assert (found[98]["chi"], found[98]["cavities"], found[98]["holes"]) == (2, 1, 0)
    assert (found[8]["chi"], found[8]["cavities"], found[8]["holes"]) == (0, 0, 1)
    assert found[98]["cx"] == pytest.approx(4.5) and found[98]["i1"] == pytest.approx(found[98]["i3"])
    assert components.filter_particles(labels, ["c"], 0, 50).select("particle").distinct().count() == 1
    feret = {round(r["feret"], 4) for r in particles.feret(labels.select("label", "x", "y", "z"), ["label"]).collect()}
    assert feret == {round(math.sqrt(48), 4), round(math.sqrt(8), 4)}


# ---- distance
def test_thickness_of_a_sphere_and_a_plate(spark):
    r = 7
    ball = [(x + 9, y + 9, z + 9) for x, y, z in itertools.product(range(-r, r + 1), repeat=3) if x * x + y * y + z * z < r * r]
    found = distance.thickness_summary(distance.local_thickness(volume(spark, ball), ["c"], (19, 19, 19)), ["c"]).first()
    assert found["max"] == pytest.approx(2 * r, abs=1.5) and found["mean"] == pytest.approx(1.944 * r - 1.219, rel=0.25)
    seeds = distance.ridge_points(volume(spark, ball), ["c"], (19, 19, 19)).collect()
    assert {(s["x"], s["y"], s["z"]) for s in seeds} == {(9.5, 9.5, 9.5)}


# ---- fits
def test_fits(spark):
    rng = np.random.default_rng(2)
    turn = ellipsoids._turned(np.array([1.0, 2.0, 3.0]), 1.0)
    p = geometry.ellipsoid_points(np.array([1.5, 2.0, 3.0]), 1000, rng) @ turn.T + [1.2, -3.4, 7.7]
    points = spark.createDataFrame([(1, *map(float, v)) for v in p], "k int, x double, y double, z double")
    found = fits.fit_ellipsoids(points, ["k"]).first()
    assert [found[c] for c in ("cx", "cy", "cz", "ra", "rb", "rc")] == pytest.approx([1.2, -3.4, 7.7, 1.5, 2, 3], abs=1e-8)
    ball = spark.createDataFrame([(1, *map(float, 2 * v / np.linalg.norm(v) + 5)) for v in rng.normal(size=(50, 3))], "k int, x double, y double, z double")
    s = fits.fit_spheres(ball, ["k"]).first()
    assert [s[c] for c in ("cx", "cy", "cz", "radius")] == pytest.approx([5, 5, 5, 2], abs=1e-9)
    assert fits.quadric_to_ellipsoid(np.diag([1.0, 1.0, -1.0, 0.0])) is None
    assert fits.quadric_to_ellipsoid(np.diag([1.0, 1.0, 1.0, -1.0]))[1] == pytest.approx([1, 1, 1])
    for q in rng.normal(size=(20, 3)) * 3:
        s = geometry.ellipsoid_points(np.array([1.0, 2.0, 3.0]), 200_000, np.random.default_rng(3))
        assert geometry.distance_to_ellipsoid(q, np.array([1.0, 2.0, 3.0])) == pytest.approx(np.linalg.norm(s - q, axis=1).min(), abs=0.02)


# ---- intercepts
def test_mil_of_sheets_and_nothing(spark):
    v = np.zeros((40, 40, 40), dtype=bool)
    turn, rng = np.eye(3), np.random.default_rng(4)
    length = 30 * np.linalg.norm(v.shape)
    assert np.linalg.norm(mil.mil_vector(v, turn, rng, length, 8, 1.0)) == pytest.approx(length)
    v[:, :, ::2] = True
    assert np.linalg.norm(mil.mil_vector(v, turn, rng, length, 8, 1.0)) == pytest.approx(1.0, rel=0.05)
    sheets = volume(spark, [(x, y, z) for x, y, z in cube(0, 19) if z % 10 < 5])
    da = mil.anisotropy(mil.mil_points(sheets, (20, 20, 20), 60, 100, seed=1).withColumn("c", F.lit(0)), ["c"]).first()["da"]
    ball = volume(spark, [(x, y, z) for x, y, z in cube(0, 19) if (x - 10) ** 2 + (y - 10) ** 2 + (z - 10) ** 2 < 64])
    round_ = mil.anisotropy(mil.mil_points(ball, (20, 20, 20), 60, 100, seed=1).withColumn("c", F.lit(0)), ["c"]).first()["da"]
    assert da > 0.5 > round_


# ---- skeletons
def test_skeleton_of_a_bar_and_a_cross(spark):
    bar = volume(spark, [(x, y, z) for x in range(12) for y in range(3) for z in range(3)])
    thin = [tuple(r)[1:] for r in skeleton.skeletonise(bar, ["c"]).collect()]
    assert 8 <= len(thin) <= 12 and {(y, z) for _, y, z in thin} == {(1, 1)}
    line = volume(spark, [(1, 1, 0), (2, 1, 0), (3, 1, 0)])
    v, b = skeleton.graph(line, ["c"])
    assert sorted((r["x"], r["y"], r["z"]) for r in v.collect()) == [(1, 1, 0), (3, 1, 0)] and b.first()["length"] == pytest.approx(2)
    two = volume(spark, [(1, 1, 0), (2, 2, 0)])
    assert skeleton.graph(two, ["c"])[1].first()["length"] == pytest.approx(math.sqrt(2))
    arms = [(5, 5, 0), *((5 + i, 5, 0) for i in range(2, 5)), *((5 - i, 5, 0) for i in range(2, 5)), *((5, 5 + i, 0) for i in range(2, 5)), (6, 5, 0), (4, 5, 0), (5, 6, 0)]
    v, b = skeleton.graph(volume(spark, arms), ["c"])
    s = skeleton.summary(v, b, ["c"]).first()
    assert (s["junctions"], s["end_points"], s["branches"], s["triple_points"]) == (1, 3, 3, 1)
    angles = sorted(r["angle"] for r in skeleton.junction_angles(v, b, ["c"]).collect())
    assert len(angles) == 3 and angles[-1] == pytest.approx(math.pi, abs=0.3)


# ---- ellipsoids
def fixed_ellipsoids(spark):
    """A fixed set of axis-aligned ellipsoids over the volume."""
    i = F.col("id")
    made = {"cx": (i * 7) % 50 + 0.5, "cy": (i * 3) % 11 + 0.5, "cz": (i * 5) % 9 + 0.5, "ra": 1.0 + i % 3, "rb": 2.5 + i % 4, "rc": 4.5 + i % 5}
    turn = {f"v{a}{b}": F.lit(float(a == b)) for a in range(3) for b in range(3)}
    return spark.range(40).select(i.alias("seed_id"), *(v.cast("double").alias(k) for k, v in (made | turn).items()))


def test_queries_measure_every_channel_in_full(spark, monkeypatch):
    from lamella.plans import measures

    points, asked = mil.mil_points, []

    def few_points(fg, shape, directions=2000, lines=10_000, **rest):
        asked.append((directions, lines))
        return points(fg, shape, 60, 100, **rest)

    def fixed(seeds, fg, shape, parameters=ellipsoids.Parameters(), **rest):
        asked.append((parameters.vectors, parameters.iterations))
        return ellipsoids.ranked(fixed_ellipsoids(spark))

    monkeypatch.setattr(mil, "mil_points", few_points)
    monkeypatch.setattr(ellipsoids, "optimise", fixed)
    expected = {r["c"] for r in measures.foreground(spark, SF).select("c").distinct().collect()}
    assert len(expected) == 3 and {r["c"] for r in measures.anisotropy(spark, SF).collect()} == expected
    assert {r["c"] for r in measures.ellipsoid_factor(spark, SF).select("c").distinct().collect()} == expected
    assert asked == [(2000, 10_000)] * 3 + [(100, 100)] * 3


def test_ellipsoid_factor(spark):
    r = 8
    ball = volume(spark, [(x + 12, y + 12, z + 12) for x, y, z in itertools.product(range(-r, r + 1), repeat=3) if x * x + y * y + z * z < r * r])
    seeds = spark.createDataFrame([(0, 12.5, 12.5, 12.5)], "seed_id bigint, x double, y double, z double")
    found = ellipsoids.optimise(seeds, ball, (25, 25, 25), ellipsoids.Parameters(iterations=20)).first()
    assert [found[k] for k in ("ra", "rb", "rc")] == pytest.approx([r, r, r], abs=1.5)
    fixed = spark.createDataFrame([(0, 2.5, 2.5, 2.5, 1.0, 1.0, 10.0, *np.eye(3).ravel().tolist()), (1, 2.5, 2.5, 2.5, 1.0, 5.0, 5.0, *np.eye(3).ravel().tolist())], "seed_id bigint, " + ", ".join(f"{c} double" for c in ellipsoids.COLUMNS))
    image = ellipsoids.factor_image(ellipsoids.assign(volume(spark, [(2, 2, 2)]), ellipsoids.with_tensors(ellipsoids.ranked(fixed)), 2))
    assert image.first()["ef"] == pytest.approx((0.9 * 10 - 0.8 * 25) / 35) and ellipsoids.flinn(image).count() == 1
    assert ellipsoids.statistics(image, 2).first()["filling"] == 50


# ---- filters, sources, streaming
def test_filters(spark):
    v = spark.createDataFrame([(0, 0, 0, z, 10 * z) for z in range(6)], "c int, x int, y int, z int, value int")
    assert [tuple(r) for r in filters.delete_slices(v, 2, 3).select("z", "value").orderBy("z").collect()] == [(0, 0), (1, 30), (2, 40), (3, 50)]
    assert filters.isodata_threshold([10, 0, 0, 0, 0, 0, 0, 10]) == 3  # the means are 0 and 7
    counts = spark.createDataFrame([(0, 2, 10), (0, 9, 10), (1, 5, 3)], "c int, value int, n bigint")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(filters.default_thresholds(counts, ["c"])) == [(0, 5.0, 9.0), (1, 5.0, 5.0)]
    assert rows(filters.default_thresholds(counts, ["c"], signed=True))[0] == (0, 5.0 - 32768, 9.0 - 32768)
    assert rows(filters.default_thresholds(counts, ["c"], hounsfield=True)) == [(0, 0.0, 4000.0), (1, 0.0, 4000.0)]
    assert filters.density_calibration(2.0, 100.0, 4.0) == (0.5, 100.0 - 32768 * 0.5, "mg HA/ccm")
    bones = spark.createDataFrame([("Mouse Femur 3",), ("x",), ("tibia and FIBULA",)], "t string").select(geometry.guess_bone(F.col("t")).alias("b"))
    assert [r["b"] for r in bones.collect()] == [7, 0, 9]


@pytest.mark.parametrize("kind", ["uint8", "uint16", "int16", "float32"])
@pytest.mark.parametrize("little", [True, False])
def test_raw_round_trip(spark, tmp_path, kind, little):
    v = spark.createDataFrame([(x, y, z, float(x + 4 * y + 12 * z)) for z in range(2) for y in range(3) for x in range(4)], "x int, y int, z int, value double")
    raw.join_raw(raw.write_raw(v, str(tmp_path / "parts"), "v", (4, 3, 2), kind, little), str(tmp_path / "v.raw"))
    back = raw.read_raw(spark, str(tmp_path / "v.raw"), (4, 3, 2), kind, byte_order="Little-endian" if little else "Big-endian")
    assert sorted(map(tuple, back.select("x", "y", "z", "value").collect())) == sorted(map(tuple, v.collect()))
    with pytest.raises(EOFError):
        raw.decoded(b"123", (2, 2, 2), "uint8")
    with pytest.raises(ValueError):
        raw.decoded(b"\2" * 8, (2, 2, 2), "uint8", zero_one=True)


def test_stl(spark, tmp_path):
    found = raw.write_stl(mesh.mesh(volume(spark, cube(1, 3)), ["c"]), ["c"], str(tmp_path), "cube").first()
    data = open(found["path"], "rb").read()
    assert len(data) == 84 + 50 * found["facets"] and int.from_bytes(data[80:84], "little") == found["facets"] and data[79:80] == b"."
    assert geometry.stl_name("a.tif", "Channel: 1, Time: 2") == "a_Channel_1_Time_2.stl"


def test_streamed_fraction_is_the_batch_one(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    streaming.stream_to_table(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "out"), str(tmp_path / "check"), lambda s: streaming.windowed_fraction(s, "ts", ["event_type"], "value", 50).select("start", "event_type", "n_fg", "n_all"))
    batch = streaming.windowed_fraction(events, "ts", ["event_type"], "value", 50).select("start", "event_type", "n_fg", "n_all")
    last = events.agg(F.max("ts").alias("t")).first()["t"]
    # windows that end before the watermark, an hour before the last event, are given
    expected = {tuple(r) for r in batch.where(F.col("start") + F.expr("interval 1 hour") <= F.lit(last) - F.expr("interval 1 hour")).collect()}
    found = [tuple(r) for r in spark.read.schema("start timestamp, event_type string, n_fg bigint, n_all bigint").parquet(str(tmp_path / "out")).collect()]
    assert len(expected) > 10 and len(found) == len(set(found)) and set(found) == expected


# ---- the registry
@pytest.mark.parametrize("name", ["element_fraction", "euler_sum", "surface_area", "particle_boxes", "fractal_dimension", "ef_image", "slice_moments", "run_average", "ellipsoid_ids", "flinn_peak_plot", "flinn_occupancy", "ef_statistics", "ef_convergence", "painted_ellipsoids", "aligned_extent", "raw_volume", "seed_union", "stream_euler", "graph_longest_paths", "axis_intercepts", "particle_cavities", "default_thresholds"])
def test_queries_are_as_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = registry.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    expected = con.execute(registry.oracle_sql()[name]).df()[columns]
    key = lambda r: tuple(round(float(v), 6) + 0.0 for v in r)
    assert sorted(map(key, rows.select(*columns).collect())) == sorted(map(key, expected.itertuples(index=False)))


# ---- odd volumes
def test_slices_without_reach_and_volumes_without_mass(spark):
    from lamella.operators import moments

    v = spark.createDataFrame([(0, 3, 4, 0, 0), (0, 1, 1, 1, 2), (0, 2, 1, 1, 2)], "c int, x int, y int, z int, value int")
    found = {r["z"]: r for r in moments.slice_moments(v, ["c"]).collect()}
    assert (found[0]["z1"], found[0]["z2"], found[0]["zpol"], found[0]["r1"]) == (None, None, None, 0.0)
    assert found[1]["z1"] is None or found[1]["z2"] is None
    assert found[1]["zpol"] == pytest.approx((0.5 + 2 / 6) / 0.5)
    empty = moments.centroid3d(v.where("z = 0"), ["c"], weight=F.col("value")).first()
    assert (empty["cx"], empty["cy"], empty["cz"]) == (-1.0, -1.0, -1.0)
    assert moments.inertia_tensor(v.where("z = 0"), ["c"], weight=F.col("value")).first()["mass"] == 0


def test_long_lines_have_the_same_envelope():
    rng = np.random.default_rng(3)
    for n in (65, 100, 257):
        lines = np.where(rng.random((40, n)) < 0.05, 0.0, distance.FAR)
        lines[3] = distance.FAR
        lines[4] = rng.integers(0, 400, n)
        lines[5:9] = rng.random((4, n)) * 50
        cost = (np.arange(n)[:, None] - np.arange(n)[None]) ** 2 * 0.49
        assert np.allclose(distance.lower_envelope(lines, 0.7), (lines[:, None, :] + cost[None]).min(axis=2), rtol=1e-12)


def test_small_point_sets_have_no_sphere(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(30, 3))
    p = p / np.linalg.norm(p, axis=1, keepdims=True) * 2 + [1, 2, 3]
    rows = [(0, *map(float, r)) for r in p] + [(1, 0.0, 0.0, 0.0)]
    found = {r["k"]: r for r in fits.fit_spheres(spark.createDataFrame(rows, "k int, x double, y double, z double"), ["k"]).collect()}
    assert found[1]["radius"] is None and found[0]["radius"] == pytest.approx(2) and found[0]["cz"] == pytest.approx(3)


def test_ellipsoids_hold_what_they_promise():
    turn = np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    e = geometry.Ellipsoid((1.0, 2.0, 3.0), (1.0, 2.0, 4.0)).turned(turn)
    assert e.contains(np.array([[1, 2, 3], [2.9, 2, 3], [1, 3.5, 3]])).tolist() == [True, True, False] and e.volume == pytest.approx(4 / 3 * math.pi * 8)
    points = e.surface(500, np.random.default_rng(1))
    assert not e.dilated(-1e-6).contains(points).any() and e.dilated(1e-6).contains(points).all()
    assert np.std(e.surface(5000, np.random.default_rng(1), 0.1) - e.surface(5000, np.random.default_rng(1))) == pytest.approx(0.1, rel=0.05)
    for bad in (((2.0, 1.0, 3.0), np.eye(3)), ((0.0, 1.0, 2.0), np.eye(3)), ((1.0, 2.0, math.nan), np.eye(3)), ((1.0, 2.0, 3.0), np.eye(3) * 2)):
        with pytest.raises(ValueError):
            geometry.Ellipsoid((0.0, 0.0, 0.0), bad[0], tuple(map(tuple, bad[1])))


def test_skeletons_by_particle(spark):
    bars = volume(spark, [(x, 1, 1) for x in range(6)] + [(x, 9, 9) for x in range(3)] + [(20, 20, 0)])
    labels = components.connected_components(bars, ["c"])
    found = sorted((r["branches"], r["branch_length"]) for r in skeleton.per_particle(labels, ["c"]).collect())
    assert found == [(0, 0.0), (1, pytest.approx(2)), (1, pytest.approx(5))]
    assert skeleton.seeds(skeleton.skeletonise(bars, ["c"])).columns == ["x", "y", "z"]


def test_graphs_are_told_apart(spark):
    vertices = spark.createDataFrame([(0, v, "end", 1, float(v), 0.0, 0.0) for v in (1, 2, 3, 10, 11)], "c int, vertex bigint, kind string, voxels bigint, x double, y double, z double")
    branches = spark.createDataFrame([(0, 1, 2, 1.5, 1), (0, 2, 3, 4.0, 3), (0, 10, 11, 2.0, 0)], "c int, v1 bigint, v2 bigint, length double, slabs bigint")
    assert {(r["skeleton"], r["branches"], r["slab_voxels"]) for r in skeleton.summary(vertices, branches, ["c"]).collect()} == {(1, 2, 4), (10, 1, 0)}
    assert {(r["skeleton"], r["branch"], r["length"], r["distance"]) for r in skeleton.ranked_branches(vertices, branches, ["c"]).collect()} == {(1, 1, 4.0, 1.0), (1, 2, 1.5, 1.0), (10, 1, 2.0, 1.0)}
    own, kept = skeleton.largest_graph(vertices, branches, ["c"])
    assert {r["vertex"] for r in own.collect()} == {1, 2, 3} and kept.count() == 2


def test_whole_measurements_check_their_images(spark):
    from lamella.operators import commands

    bar = volume(spark, [(x, y, z) for x in range(2, 9) for y in (3, 4) for z in (0, 1, 2)])
    for call in (lambda: commands.slice_geometry(bar, ["c"], (10, 10, 3), last=4), lambda: commands.moments_of(bar, ["c"], (10, 10, 0)), lambda: commands.branch_angles(bar, ["c"], (10, 10, 3), (1.0, 0.0, 1.0))):
        with pytest.raises(InvalidImage):
            call()
    found = {r["z"]: r for r in commands.slice_geometry(bar, ["c"], (10, 10, 3), first=2).collect()}
    assert set(found) == {1, 2} and found[1]["n"] == 14 and found[1]["perimeter"] == 18 and found[1]["theta"] == 0 and found[1]["flat_max"] == 2
    m = commands.moments_of(bar, ["c"], (10, 10, 3)).first()
    assert (m["cx"], m["cy"], m["cz"]) == (5, 3.5, 2) and abs(m["v00"]) == pytest.approx(1) and m["i1"] >= m["i2"] >= m["i3"]
    cross = volume(spark, [(5 + i, 5, 0) for i in range(-4, 5)] + [(5, 5 + i, 0) for i in range(1, 5)] + [(20, 20, 0), (21, 20, 0)])
    trees, branches = commands.analysed_skeletons(cross, ["c"], (30, 30, 1), thin=False)
    assert sorted((r["branches"], r["end_points"]) for r in trees.collect()) == [(1, 2), (3, 3)] and branches.where("branch = 1").count() == 2
    angles, culled = commands.branch_angles(cross, ["c"], (30, 30, 1), margin=3, thin=False)
    assert culled.first()["dead_end"] == 100 and angles.count() == 0


def test_particle_columns_of_a_ball(spark):
    r = 5
    ball = volume(spark, [(x + 8, y + 8, z + 8) for x, y, z in itertools.product(range(-r, r + 1), repeat=3) if x * x + y * y + z * z <= r * r])
    p = particles.analyse(ball, ["c"], image=(17, 17, 17)).first()
    # the mesh goes through the outermost voxels, whose distances are from 4.1 to 5
    assert p["feret"] == 10 and (p["chi"], p["cavities"], p["holes"]) == (1, 0, 0) and p["thickness"] > 9
    assert [p[f"ell_{k}"] for k in ("ra", "rb", "rc")] == pytest.approx([4.6, 4.6, 4.6], abs=0.4) and p["ell_cx"] == pytest.approx(8, abs=0.6)
    assert list(p["box_lengths"]) == pytest.approx([10, 10, 10], abs=1.5)


def test_numbers_by_ranges(spark):
    rows = spark.range(1000).repartition(7).select(F.col("id"), (F.col("id") * 37 % 101).alias("k"))
    found = [r["n"] for r in filters.numbered(rows, [F.col("k").desc(), F.col("id")], "n").orderBy(F.col("k").desc(), "id").collect()]
    assert found == list(range(1000)) and filters.numbered(rows.limit(0), [F.col("k")], "n").count() == 0


# ---- paths, pruning, slices
def test_paths_pruning_and_outlines(spark):
    from lamella.operators import moments

    arms = [(5 + i, 5, 0) for i in range(-6 + 2, 7)] + [(5, 5 + i, 0) for i in range(1, 5)]
    v, b = skeleton.graph(volume(spark, arms), ["c"])
    path = skeleton.longest_shortest_paths(v, b, ["c"]).first()
    assert path["length"] == pytest.approx(8)  # lengths end at the nearest voxel of a junction
    left, kept, culled = skeleton.prune(v, b, ["c"], 1.5)
    c = culled.first()
    assert c["dead_end"] == 100 and kept.count() == 0 and left.count() <= v.count()
    square = volume(spark, [(x, y, 0) for x in range(4) for y in range(3)])
    o = moments.slice_outline(square, ["c"], (0.5, 0.5)).first()
    assert o["perimeter"] == pytest.approx(7.0) and o["feret_max"] == pytest.approx(2.5) and o["feret_min"] == pytest.approx(1.5)
    t = distance.slice_thickness(volume(spark, [(x, y, z) for x in range(1, 10) for y in range(2, 5) for z in (1, 2)]), ["c"], (11, 7, 5)).collect()
    assert {r["z"] for r in t} == {1, 2} and all(r["max"] == 4.0 for r in t)
    assert moments.orientation_quadrant(0.1) == "right" and moments.orientation_quadrant(math.pi / 2) == "up"
