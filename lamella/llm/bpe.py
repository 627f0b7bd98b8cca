"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word is held as its parts (token ids) and the ranks of adjacent pairs, both contiguous. The least rank is
looked for, the boundary there deleted, and the two neighbouring ranks looked up anew, until no pair has a rank.
Short words go through this many at a time, as rows of a matrix; longer ones alone; and very long ones by a heap
over linked parts, since repeated scans would take quadratic time. All three merge the leftmost pair of least rank,
so their results are the same.

Defined results: a null text is as an empty one (no ids, decoded text empty); rows are independent of each other,
so repeated rows and repeated ids give equal rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm._common import TwoGenerations, cut, held, spread

#: Fixed values of the public byte-level format: its pattern of words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "byte_bpe_50k.json"
SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]
NO_RANK = np.int64(1 << 40)
MATRIX_BYTES = 32
ARRAY_BYTES = 512
CACHED_CHUNKS = 40_000
BLOCK_CHARS = 4_000_000


def vocabulary_path(vocabulary: str) -> str:
    """A path as it is; a bare file name is one of the installed public vocabularies."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def printable_bytes() -> dict[str, int]:
    """The byte that each character of a token stands for: printable Latin-1 stands for itself, others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, as_byte = spec["model"]["vocab"], printable_bytes()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.base = np.zeros(256, dtype=np.int64)
        for c, b in as_byte.items():
            self.base[b] = vocabulary[c]
        self.size = size
        pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs[vocabulary[a] * size + vocabulary[b]] = (rank, vocabulary[a + b])
        self.pairs = pairs
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        values = np.array(list(pairs.values()), dtype=np.int64)
        self.ranks, self.merged = values[order, 0], values[:, 1]
        self.words = regex.compile(WORDS)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache = TwoGenerations(CACHED_CHUNKS)

    # ranks of pairs
    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NO_RANK)

    def matrix(self, words: list[bytes], out: dict[bytes, bytes]) -> None:
        """Puts the ids of distinct words of the same length, at most MATRIX_BYTES, into out; all words at once."""
        count, length = len(words), len(words[0])
        parts = self.base[np.frombuffer(b"".join(words), dtype=np.uint8).reshape(count, length)]
        which = np.arange(count)
        ranks = self.ranks_of(parts[:, :-1], parts[:, 1:]) if length > 1 else np.empty((count, 0), dtype=np.int64)

        def put(which: np.ndarray, parts: np.ndarray) -> None:
            data, step = parts.astype("<u4").tobytes(), 4 * parts.shape[1]
            out.update(zip(map(words.__getitem__, which.tolist()), (data[i : i + step] for i in range(0, len(data), step))))

        while len(which):
            if not ranks.shape[1]:
                put(which, parts)
                break
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(which)), at]
            done = best >= NO_RANK
            if done.any():
                put(which[done], parts[done])
                keep = ~done
                which, parts, ranks, at, best = which[keep], parts[keep], ranks[keep], at[keep], best[keep]
                if not len(which):
                    break
            # delete the boundary: the part after it goes, and its rank with it
            parts[np.arange(len(which)), at] = self.merged[best]
            column = np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, column + (column > at[:, None]), axis=1)
            column = np.arange(ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), axis=1)
            # the neighbouring ranks
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.ranks_of(parts[left, at[left] - 1], parts[left, at[left]])
            right = np.flatnonzero(at < ranks.shape[1])
            ranks[right, at[right]] = self.ranks_of(parts[right, at[right]], parts[right, at[right] + 1])

    def array(self, word: bytes) -> list[int]:
        """The ids of one word, by a rank array of its own."""
        parts = self.base[np.frombuffer(word, dtype=np.uint8)].tolist()
        none, size, get = (int(NO_RANK), 0), self.size, self.pairs.get
        ranks = [get(a * size + b, none)[0] for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best >= NO_RANK:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [int(self.merged[best])]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] * size + parts[at], none)[0]
            if at < len(ranks):
                ranks[at] = get(parts[at] * size + parts[at + 1], none)[0]
        return parts

    def heap(self, word: bytes) -> list[int]:
        """The ids of one very long word."""
        parts = self.base[np.frombuffer(word, dtype=np.uint8)].tolist()
        n, size, get = len(parts), self.size, self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(get(parts[i] * size + parts[i + 1])[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if parts[i] * size + parts[i + 1] in self.pairs]
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.merged[rank]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (found := get(parts[left] * size + parts[right])):
                    heapq.heappush(queue, (found[0], left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct words, as little-endian unsigned 32-bit integers."""
        out: dict[bytes, bytes] = {}
        by_length: dict[int, list[bytes]] = {}
        for w in words:
            if len(w) <= MATRIX_BYTES:
                by_length.setdefault(len(w), []).append(w)
            else:
                out[w] = np.array(self.array(w) if len(w) <= ARRAY_BYTES else self.heap(w), dtype="<u4").tobytes()
        for length, group in by_length.items():
            if not length:
                out[b""] = b""
                continue
            for i in range(0, len(group), 50_000):
                self.matrix(group[i : i + 50_000], out)
        return out

    # texts
    def parts_of(self, text: str) -> list[str]:
        """The words of a text, and the special tokens that stand in it."""
        if text[1:].isalpha() and text[0] == " ":
            return [text]
        if any(s in text for s in self.special):
            return [w for segment in self.specials.split(text) if segment for w in ([segment] if segment in self.special else self.words.findall(segment))]
        return self.words.findall(text)

    def chunks(self, text: str) -> list[str]:
        """Pieces of text whose encodings, one after the other, are the text's. A space between two other characters that
        are no white space begins a word in any context, so such spaces part a text; else its words are found at once."""
        if "\0" not in text and not any(w in text and (f" {w}" in text or f"{w} " in text) for w in SPACES) and text[:1] != " " and text[-1:] != " ":
            return text.replace(" ", "\0 ").split("\0") if text else []
        return self.parts_of(text)

    def fill(self, keys: set[str]) -> None:
        """Puts the encodings of all keys into the cache."""
        new = self.cache.lacking(keys)
        counts, words = [], []
        for k in new:
            w = self.parts_of(k)
            counts.append(len(w))
            words += w
        found = self.encode_words([w.encode() for w in set(words).difference(self.special)])
        ids = {w: i.to_bytes(4, "little") for w, i in self.special.items()}
        at, cache = 0, self.cache
        for k, n in zip(new, counts):
            if n == 1:
                w = words[at]
                cache[k] = ids[w] if w in ids else found[w.encode()]
            else:
                cache[k] = b"".join([ids[w] if w in ids else found[w.encode()] for w in words[at : at + n]])
            at += n

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        block: list[list[str]] = []
        chars = 0
        for i, text in enumerate(texts):
            block.append(self.chunks(text))
            chars += len(text)
            if chars >= BLOCK_CHARS or i == len(texts) - 1:
                self.fill(set().union(*block))
                out += [b"".join(map(self.cache.__getitem__, keys)) for keys in block]
                block, chars = [], 0
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids of special tokens their strings."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


def loaded(vocabulary: str) -> ByteBPE:
    """The vocabulary, read once for each Python worker."""
    return held("bytes", vocabulary, lambda name: ByteBPE(vocabulary_path(name)))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(1).to_pylist()]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """id_col, n_tokens and ids (array of int) of every whole text."""

    def run(batches):
        bpe = loaded(vocabulary)
        for batch in cut(batches, 1):
            ids = bpe.encode_batch(_texts(batch))
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            values = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), lists], names=[id_col, "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """id_col and text of every list of ids; null is as an empty list."""

    def run(batches):
        bpe = loaded(vocabulary)
        for batch in batches:
            texts = [bpe.decode(np.array(ids or [], dtype=np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256: digests of every text's ids and of the text decoded from them."""

    def run(batches):
        bpe = loaded(vocabulary)
        for batch in cut(batches, 1):
            counts, of_ids, of_text = [], [], []
            for ids in bpe.encode_batch(_texts(batch)):
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, dtype="<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
