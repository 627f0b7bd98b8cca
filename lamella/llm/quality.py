"""Quality rules: length, symbol, repetition and line rules, and the fertility of a public tokeniser.

Fertility is measured with a piece vocabulary that falls back on bytes. Each white-space word is encoded by itself (and
kept, as words repeat), so a text's tokens are those of its words: characters per token (over words with a letter, as digits
are a token each in any language), the share of tokens that are bytes, and the entropy of the text's tokens in bits. Each has a band per language; a language without bands gets those
of the script that most letters of the text are of; a script without bands has none, and its texts aren't rejected by
them. A short text's figures scatter, so its limits are wider, by the number of its tokens; no text goes unjudged.

The bands of en, de, es and fr were set from the 8,506 distinct texts of a synthetic corpus (sf0.1) that pass the base rules: of
texts of 200 tokens and more the least characters per token are 1.80, 1.77, 1.76 and 1.65 (invented words; natural text
has 2.5 to 4.5), while random letters have 1.65 at most and letters with digits 1.3. Those of other languages and scripts are
not measured on a corpus, and wider.

Defined results: a null text is as an empty one (no words, rejected for fewer than ten words); a null or unknown
language goes by script; rows are independent of each other, so repeated rows and ids give equal rows; an empty table
gives no rows; other columns are not read, and the filter hands them on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm._common import TwoGenerations, cut, held, spread
from lamella.llm.bpe import vocabulary_path

DEFAULT_PIECES = "piece_bpe_32k.model"
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
CACHED_WORDS = 40_000
WINDOW = 5
BLOCK_CHARS = 4_000_000
#: Of the texts that a worker holds as words at once.
WORD_BYTES = 1_000_000
#: Letters of scripts by their ranges; the first that holds the most letters counts.
SCRIPTS = {
    "latin": "A-Za-zÀ-ɏ",
    "greek": "Ͱ-Ͽ",
    "cyrillic": "Ѐ-ԯ",
    "hebrew": "֐-׿",
    "arabic": "؀-ۿ",
    "devanagari": "ऀ-ॿ",
    "kana": "぀-ヿ",
    "han": "㐀-鿿",
    "hangul": "가-힯",
}
FEATURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, n_tokens bigint, chars_per_token double, byte_share double, token_entropy double, kept boolean"


@dataclass(frozen=True)
class Band:
    """Limits, ends included: characters per token, share of byte tokens, entropy in bits. A text of n tokens, m of them of words with
    letters, may have slack / sqrt(m) characters a token less or more, and its entropy is asked for up to half of log2(n) only."""

    least_chars: float = 0.0
    most_chars: float = 1e9
    most_bytes: float = 1.0
    least_entropy: float = 0.0
    slack: float = 1.5

    def holds(self, tokens: int, lettered: int, chars_per_token: float, byte_share: float, entropy: float) -> bool:
        if lettered and not self.least_chars - self.slack / lettered**0.5 <= chars_per_token <= self.most_chars + self.slack / lettered**0.5:
            return False
        return not tokens or (byte_share <= self.most_bytes and entropy >= min(self.least_entropy, np.log2(tokens) / 2))


BANDS: dict[str, Band] = {
    "en": Band(1.80, 7.0, 0.05, 4.0),
    "de": Band(1.80, 7.0, 0.05, 4.0),
    "es": Band(1.70, 7.0, 0.05, 4.0),
    "fr": Band(1.70, 7.0, 0.05, 4.0),
    **dict.fromkeys(("it", "pt", "nl"), Band(1.65, 7.0, 0.05, 4.0)),
    "latin": Band(1.5, 8.0, 0.10, 3.0),
    **dict.fromkeys(("greek", "cyrillic", "hebrew", "arabic"), Band(0.8, 8.0, 0.30, 3.0)),
    **dict.fromkeys(("devanagari", "kana", "han", "hangul"), Band(0.2, 4.0, 0.95, 2.0)),
}

#: In the bytes of a word: a letter of ASCII, or any other character beyond it.
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


class Pieces:
    """A piece model with the words that it has lately encoded; encodings of words without letters are of the type bytearray."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.cache = TwoGenerations(CACHED_WORDS)

    def fill(self, words: set[bytes]) -> None:
        new = self.cache.lacking(words)
        for i in range(0, len(new), 10_000):
            some = new[i : i + 10_000]
            ids = self.model.encode([w.decode() for w in some], num_threads=1)
            self.cache.update((w, (bytes if LETTER.search(w) else bytearray)(np.array(x, dtype="<u2"))) for w, x in zip(some, ids))

    def measures(self, words: list[bytes]) -> tuple[int, int, float, float, float]:
        """Tokens, those of words with letters, characters for each of these, share of byte tokens, entropy of the tokens."""
        found = list(map(self.cache.__getitem__, words))
        data = b"".join(found)
        ids = np.frombuffer(data, dtype="<u2")
        if not len(ids):
            return 0, 0, 0.0, 0.0, 0.0
        others = [(len(v), len(w.decode())) for w, v in zip(words, found) if type(v) is bytearray]
        lettered = len(ids) - sum(n for n, _ in others) // 2
        chars = len(b"".join(words).decode()) - sum(n for _, n in others)
        ids = np.sort(ids, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        counts = np.diff(np.append(first, len(ids)))
        share = float(counts[self.is_byte[ids[first]]].sum()) / len(ids)
        entropy = max(0.0, float(np.log2(len(ids)) - (counts * np.log2(counts)).sum() / len(ids)))
        return len(ids), lettered, chars / lettered if lettered else 0.0, share, entropy


def loaded(pieces: str) -> Pieces:
    return held("pieces", pieces, lambda name: Pieces(vocabulary_path(name)))


_LETTERS = {name: re.compile(f"[{ranges}]") for name, ranges in SCRIPTS.items()}


def script_of(text: str) -> str | None:
    """The script of most letters; ties go to the one that SCRIPTS has first; None if no letter is known."""
    counts = {name: len(found.findall(text)) for name, found in _LETTERS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else None


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that the text has twice or more, the first such window included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        window = h[:n].copy()
        for i in range(1, WINDOW):
            window = window * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + n]
            window ^= window >> np.uint64(31)
    ordered = np.sort(window)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    repeats = np.unique(ordered[1:][same])
    place = np.minimum(np.searchsorted(repeats, window), len(repeats) - 1)
    twice = repeats[place] == window
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split("\n") if x and x.strip(SPACES)]
    return len(lines) - len(set(lines))


def judged(texts: list[str], langs: list[str | None], pieces: Pieces, bands: dict[str, Band]) -> dict[str, list]:
    out: dict[str, list] = {x.split()[0]: [] for x in FEATURES.split(", ")}
    start = 0
    while start < len(texts):
        stop, chars, block = start, 0, []
        while stop < len(texts) and (stop == start or chars < BLOCK_CHARS):
            block.append(texts[stop].encode().split())  # the white space of bytes is \x20 and \x09-\x0D
            chars += len(texts[stop])
            stop += 1
        pieces.fill(set().union(*block))
        for text, lang, words in zip(texts[start:stop], langs[start:stop], block):
            n, chars_in_words = len(words), len(text) - sum(map(text.count, SPACES))
            repeats = repeated_words(words)
            failed = n < 10 or 100 * repeats > 20 * n
            tokens, lettered, per_token, share, entropy = pieces.measures(words)
            band = bands.get((lang or "").lower()) or bands.get(script_of(text) or "")
            good = band is None or band.holds(tokens, lettered, per_token, share, entropy)
            for k, v in zip(out, (n, chars_in_words, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeats, failed, tokens, per_token, share, entropy, not failed and bool(good))):
                out[k].append(v)
        start = stop
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", pieces: str = DEFAULT_PIECES, bands: dict[str, Band] | None = None) -> DataFrame:
    """id_col and FEATURES for every whole text; kept is the verdict of all rules."""
    bands = BANDS if bands is None else bands

    def run(batches):
        model = loaded(pieces)
        for b in cut(batches, 1, WORD_BYTES):
            found = judged([t or "" for t in b.column(1).to_pylist()], b.column(2).to_pylist(), model, bands)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, found.values())], names=[id_col, *found])

    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    out = pa.schema([(id_col, to_arrow_type(kind)), *((x.split()[0], {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]]) for x in FEATURES.split(", "))])
    return spread(docs.select(F.col(id_col), F.col(text_col), F.col(lang_col).cast("string"))).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, {FEATURES}")


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", pieces: str = DEFAULT_PIECES, bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows of docs, all columns, whose texts no rule rejects."""
    bands = BANDS if bands is None else bands
    text, lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        model = loaded(pieces)
        for b in cut(batches, text, WORD_BYTES):
            found = judged([t or "" for t in b.column(text).to_pylist()], b.column(lang).to_pylist(), model, bands)
            yield b.filter(pa.array(found["kept"], pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)


#: The base columns in DuckDB's SQL, over whole texts.
BASE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
gram AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM (SELECT r, i, w[i + 1 : i + 5] AS g FROM (SELECT r, w, unnest(range(len(w) - 4)) AS i FROM w WHERE len(w) >= 5))),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM gram WHERE n > 1) GROUP BY r),
line AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  coalesce(line.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(again.n, 0) > 20 * len(w) AS base_failed
FROM w LEFT JOIN again USING (r) LEFT JOIN line USING (r)
"""
