"""Token ids in Arrow files of fixed-size-list batches, with random access to sequences, masks and documents.

Documents are dealt into shards in ascending order of their ids; a task encodes its shard in that order and packs the
ids into sequences of equal length. A shard has two files: `tokens-*.arrow`, record batches of `ids`
(fixed_size_list<uint16 or uint32>[length]) and `mask` (fixed_size_list<bool>[length], false where a shard's last
sequence is padded); and `docs-*.arrow`, each document's id, start in the shard and number of ids. Every batch but the
last has the same number of sequences, so sequence s is row s % rows of batch s // rows, and a reader maps the file and
slices buffers without copying.

Words between ASCII white space are encoded by the tokenizers library one by one and kept, which gives the ids of the
whole text: its normalizer and word pattern never reach across white space (white space is dropped), and special tokens
hold none. Words of Western letters with punctuation after them, if any, go to the library's model at once, as its normalizer
changes nothing in them and its pattern parts them there. `whole_texts=True` hands it whole texts instead, for a tokenizer
of which that isn't so.

Defined results: a null text is as an empty one (the end id alone); null ids sort first; rows of equal ids are in the
order of their texts, and equal rows each have their place; an empty table gives no files and no rows; other columns
aren't read.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm._common import TwoGenerations, held
from lamella.llm._files import WholeFile, commit_manifest, store
from lamella.llm._shards import shard_plan
from lamella.llm.bpe import printable_bytes, vocabulary_path

DEFAULT_VOCABULARY = "word_bpe_49k.json"
END_ID = 2
LENGTH = 2048
ROWS = 256
SHARD_BYTES = 24 << 20
CACHED_WORDS = 300_000
#: Letters that no normalizer changes, then ASCII punctuation without the apostrophe: two pieces of the tokenizer's pattern.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: Fixed values of the public tokenizer: how it normalizes and parts a text, which PLAIN counts on.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
BLOCK_BYTES = 10_000_000


class WordCache:
    """The tokenizer with the ids of the words that it has lately encoded, as bytes of little-endian integers."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache = TwoGenerations(CACHED_WORDS)
        self.model = self.tokenizer.model
        self.bytes_of = [int(i).to_bytes(self.dtype.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        spec = json.loads(self.tokenizer.to_str())
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.plain = (spec.get("normalizer") or {}).get("normalizers") == NORMALIZER and first.get("pattern") == {"Regex": PATTERN} and not spec["model"].get("dropout")
        of = {b: c for c, b in printable_bytes().items()}
        self.as_bytes = {i: "".join(of[b] for b in chr(i).encode()) for i in range(256) if i >= 128}

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece(self, piece: str) -> bytes:
        """The ids of letters or punctuation of a plain word; the word's encoding if it is all of it."""
        tokens = self.model.tokenize(piece if piece.isascii() else piece.translate(self.as_bytes))
        return b"".join([self.bytes_of[t.id] for t in tokens])

    def fill(self, new: list[str]) -> None:
        """Puts the ids of new words into the cache."""
        cache, others, ends = self.cache, [], {}
        for w in new:
            found = PLAIN.fullmatch(w) if self.plain else None
            if found is None:
                others.append(w)
                continue
            letters, end = found.groups()
            ids = cache.get(letters) if end else None
            if ids is None:
                ids = cache[letters] = self.piece(letters)
            if end:
                if end not in ends:
                    ends[end] = self.piece(end)
                cache[w] = ids + ends[end]
        for i in range(0, len(others), 20_000):
            cache.update(zip(others[i : i + 20_000], self.encoded(others[i : i + 20_000])))

    def encode_batch(self, texts: pa.Array, whole_texts: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one text after the other, and how many each has."""
        if whole_texts:
            ids = self.encoded(texts.to_pylist())
            return np.frombuffer(b"".join(ids), dtype=self.dtype), np.array([len(x) // self.dtype.itemsize for x in ids], dtype=np.int64)
        # in lower case most words are plain; texts that may hold special tokens are left as they are
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        words = lists.flatten().dictionary_encode()
        keys, which = words.dictionary.to_pylist(), words.indices.to_numpy()
        own = list(map(self.cache.get, keys))
        new = [i for i, x in enumerate(own) if x is None]
        self.fill(self.cache.lacking([keys[i] for i in new]))
        for i in new:
            own[i] = self.cache[keys[i]]
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(own), dtype=self.dtype)
        counts = sizes[which]
        ends = np.concatenate(([0], np.cumsum(counts)))
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], counts)
        at += np.arange(len(at))
        return pool[at], np.diff(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()])


def with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and counts with an id more at the end of each text."""
    out = np.full(len(ids) + len(counts), end_id, dtype=ids.dtype)
    own = np.ones(len(out), dtype=bool)
    own[np.cumsum(counts + 1) - 1] = False
    out[own] = ids
    return out, counts + 1


def loaded(vocabulary: str) -> WordCache:
    return held("words", vocabulary, lambda name: WordCache(vocabulary_path(name)))


class ShardWriter:
    """The two files of one shard, written in order."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, id_type: pa.DataType, length: int, rows: int):
        self.length, self.rows, self.dtype = length, rows, dtype
        self.kind = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"length": str(length), "rows": str(rows)})
        self.index = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [WholeFile(folder, f"{what}-{shard:06d}.arrow") for what in ("tokens", "docs")]
        self.tokens, self.docs = (pa.ipc.new_file(f.out, s) for f, s in zip(self.files, (self.kind, self.index)))
        self.held, self.held_ids = [], 0
        self.n_docs = self.n_tokens = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        ends = self.n_tokens + np.cumsum(counts)
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(ends - counts), pa.array(counts)], schema=self.index))
        self.n_docs += len(counts)
        self.n_tokens += len(ids)
        self.held.append(ids)
        self.held_ids += len(ids)
        if self.held_ids >= self.length * self.rows:
            self.flush(False)

    def flush(self, last: bool) -> None:
        values = np.concatenate(self.held) if self.held else np.zeros(0, dtype=self.dtype)
        step = self.length * self.rows
        stop = len(values) if last else len(values) // step * step
        for i in range(0, stop, step):
            some = values[i : min(i + step, stop)]
            short = -len(some) % self.length
            mask = pa.array(np.arange(len(some) + short) < len(some))
            some = np.concatenate([some, np.zeros(short, dtype=self.dtype)]) if short else some
            self.tokens.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(some), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.kind))
        self.held = [values[stop:].copy()]
        self.held_ids = len(values) - stop

    def close(self) -> None:
        self.flush(True)
        for writer, file in zip((self.tokens, self.docs), self.files):
            writer.close()
            file.commit()


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, end_id: int = END_ID, length: int = LENGTH, rows: int = ROWS, shard_bytes: int = SHARD_BYTES, whole_texts: bool = False) -> DataFrame:
    """Writes the files; (shard, n_docs, n_tokens) of each, from the manifest."""
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shard, shards = shard_plan(plain, "id", F.octet_length("text") + 64, shard_bytes)
    dealt = plain.withColumn("shard", shard.cast("int")).repartitionById(shards, "shard").sortWithinPartitions("id", "text")

    def run(batches):
        words, writer, number = loaded(vocabulary), None, 0
        for b in batches:
            texts, start = b.column(1), 0
            ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
            while start < len(texts):
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_BYTES)))
                if writer is None:
                    number = b.column(2)[0].as_py()
                    writer = ShardWriter(folder, number, words.dtype, b.column(0).type, length, rows)
                writer.add(b.column(0).slice(start, stop - start), *with_ends(*words.encode_batch(texts.slice(start, stop - start), whole_texts), end_id))
                start = stop
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int32()), "n_docs": pa.array([writer.n_docs], pa.int64()), "n_tokens": pa.array([writer.n_tokens], pa.int64())})

    return commit_manifest(dealt.mapInArrow(run, "shard int, n_docs bigint, n_tokens bigint"), folder)


@dataclass
class Shard:
    """One shard's files, mapped (or held, where the store can't be mapped)."""

    folder: str
    number: int

    def __post_init__(self):
        files, at = store(self.folder)
        open_ = (lambda p: pa.memory_map(p)) if files.type_name == "local" else files.open_input_file
        self.tokens, self.docs = (pa.ipc.open_file(open_(f"{at}/{what}-{self.number:06d}.arrow")) for what in ("tokens", "docs"))
        meta = self.tokens.schema.metadata
        self.length, self.rows = int(meta[b"length"]), int(meta[b"rows"])

    def sequence(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence s, neither copied: the ids are a view of the file, and the mask, true over a sequence's first
        ids alone, is a view of a run of true and false that all sequences share. `mask_bits` is the file's own."""
        ids = self.tokens.get_batch(s // self.rows).column(0).flatten().slice(s % self.rows * self.length, self.length)
        if getattr(self, "_both", None) is None:
            self._both = np.repeat([True, False], self.length)
            self._last = self.tokens.num_record_batches - 1
            rows = self.tokens.get_batch(self._last).num_rows
            self._last = self._last * self.rows + rows - 1
            self._held = self.mask_bits(self._last).true_count
        held = self._held if s == self._last else self.length
        return ids.to_numpy(), self._both[self.length - held : 2 * self.length - held]

    def mask_bits(self, s: int) -> pa.BooleanArray:
        """The mask of sequence s as the file's bits, a view."""
        return self.tokens.get_batch(s // self.rows).column(1).flatten().slice(s % self.rows * self.length, self.length)

    def ids(self, start: int, count: int) -> np.ndarray:
        """So many ids from start on; a view where they lie in one batch."""
        step, out = self.length * self.rows, []
        while count > 0:
            b, at = divmod(start, step)
            if getattr(self, "_at", None) != b:
                self._at, self._flat = b, self.tokens.get_batch(b).column(0).flatten().to_numpy()
            out.append(self._flat[at : at + count])
            start, count = start + len(out[-1]), count - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out)


def read_index(spark: SparkSession, manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """doc_id, start over all shards, n_tokens and ids_crc32 of every document, from the files. The driver holds one
    number a shard."""
    counts = sorted((r["shard"], r["n_tokens"]) for r in manifest.select("shard", "n_tokens").collect())
    bases, base = [], 0
    for shard, n in counts:
        bases.append((shard, base))
        base += n

    def run(batches):
        for b in batches:
            for number, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard(folder, number)
                for k in range(shard.docs.num_record_batches):
                    d = shard.docs.get_batch(k)
                    starts, n = d.column(1).to_numpy(), d.column(2).to_numpy()
                    crc = [zlib.crc32(shard.ids(s, c).astype("<u4").tobytes()) for s, c in zip(starts.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([d.column(0), pa.array(starts + base), d.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame(bases, "shard int, base bigint")
    return shards.repartition(max(1, len(bases)), "shard").mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
