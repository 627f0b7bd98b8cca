"""Secret scan: patterns of assignments, access keys and hexadecimal runs, and a token-efficiency test.

The patterns run over a text's bytes, and only over texts that hold their literal parts. The test takes runs of the
characters of keys and encodings, without what the patterns' spans cover of them, and asks how many characters a token of a
public vocabulary covers in the mean: words, names of programs and paths are covered by long tokens (2.1 characters and more),
random strings by short ones (1.3 to 1.9). Runs that are a known digest (hexadecimal of a digest's length, or in base 64 after
its name), a UUID, a date or a number are left out. Long runs are measured by pieces of PIECE characters. Where a run as a whole is
covered by long tokens, its parts between `/ - _ =` are judged alone, so a key at the end of a path or behind a name is found. Runs and
parts under LEAST_RUN characters aren't judged, nor are stretches of a part: a key glued to a word, or one cut by `/ - _ =` into shorter
parts behind words, is missed.

Defined results: a null text is as an empty one, with no spans; rows are independent of each other, so repeated rows and
ids give equal rows; an empty table gives no rows; other columns are not read; a text takes time in proportion to its length.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm._common import cut, held, spread
from lamella.llm.bpe import WORDS, vocabulary_path

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: In order of the spans' names where they start together.
KINDS = ("assign", "access", "hex", "token")
LEAST_RUN, MOST_CHARS_A_TOKEN, PIECE = 20, 1.9, 1000
LITERALS = (b"password", b"passwd", b"secret", b"token", b"api")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
RUN = re.compile(rb"[A-Za-z0-9+/=_-]{%d,}" % LEAST_RUN)
PART = re.compile(rb"[A-Za-z0-9+]{%d,}" % LEAST_RUN)
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
KNOWN = re.compile(rb"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|\d{4}-\d\d-\d\d[-T\d]*|[\d/=+_-]+|sha(1|256|384|512)[-=][A-Za-z0-9+/]+=*")
WHOLE_HEX = re.compile(rb"[0-9a-f]+|[0-9A-F]+")


def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary_path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def loaded(vocabulary: str):
    return held("tiktoken", vocabulary, _encoding)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes; the first three of KINDS."""
    out = []
    low = text.lower()  # of bytes: A-Z alone
    if any(x in low for x in LITERALS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def uncovered(runs, base: list[tuple[int, int, int]]):
    """(start, end) of the parts of runs (matches in order) that no span covers; one walk over both."""
    covers = sorted((s, e) for s, _, e in base)
    at = 0
    for m in runs:
        start, end = m.span()
        while at < len(covers) and covers[at][1] <= start:
            at += 1
        k = at
        while k < len(covers) and covers[k][0] < end:
            if covers[k][0] > start:
                yield start, covers[k][0]
            start = max(start, covers[k][1])
            at, k = k, k + 1
        if start < end:
            yield start, end


def chars_a_token(run: str, encoding) -> float:
    return len(run) / sum(len(encoding.encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def random_spans(text: bytes, base: list[tuple[int, int, int]], encoding) -> list[tuple[int, int, int]]:
    """(start, kind, end) of runs with few characters a token, beside the spans of base, that are nothing known."""
    out = []
    for start, end in uncovered(RUN.finditer(text), base):
        run = text[start:end]
        if _known(run):
            continue
        if chars_a_token(run.decode(), encoding) <= MOST_CHARS_A_TOKEN:
            out.append((start, 3, end))
            continue
        parts = [m.span() for m in PART.finditer(run) if m.end() - m.start() < len(run) and not _known(m.group())]
        out += [(start + a, 3, start + b) for a, b in parts if chars_a_token(run[a:b].decode(), encoding) <= MOST_CHARS_A_TOKEN]
    return out


def _known(run: bytes) -> bool:
    """Whether a run is too short to be judged, or something known that isn't secret."""
    return len(run) < LEAST_RUN or bool(KNOWN.fullmatch(run)) or bool(len(run) in DIGEST_LENGTHS and WHOLE_HEX.fullmatch(run))


def _named(text: bytes, spans: list[tuple[int, int, int]]) -> list[str]:
    """kind:start:end in code points, by start, then kind."""
    spans = sorted(spans)
    if spans and not text.isascii():
        before = np.concatenate(([0], np.cumsum(np.frombuffer(text, dtype=np.uint8) & 0xC0 != 0x80)))
        spans = [(int(before[s]), k, int(before[e])) for s, k, e in spans]
    return [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """id_col, n_assign, n_access, n_hex, n_token, base_sha256 and spans of every whole text."""

    def run(batches):
        encoding = loaded(vocabulary)
        for b in cut(batches, 1):
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for t in b.column(1).to_pylist():
                text = (t or "").encode()
                base = base_spans(text)
                every = base + random_spans(text, base, encoding)
                for k, of in enumerate(counts):
                    of.append(sum(x[1] == k for x in every))
                digests.append(hashlib.sha256(",".join(_named(text, base)).encode()).hexdigest())
                spans.append(",".join(_named(text, every)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=[id_col, "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_token bigint, base_sha256 string, spans string")


#: The base columns in DuckDB's SQL, over whole texts. A match's place follows from the pieces between matches, and the matches before it.
BASE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
kind AS (SELECT * FROM (VALUES (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?', 12),
  (1, 'access', 'AKIA[A-Z0-9]+', '^', 18), (2, 'hex', '[0-9a-f]+', '^', 16)) k(k, name, pattern, head, least)),
m AS (SELECT r, k, name, head, least, regexp_extract_all(t, pattern) AS found, string_split_regex(t, pattern) AS between_ FROM d, kind),
one AS (SELECT r, k, name, head, least, unnest(found) AS hit, unnest(list_transform(between_[1 : len(found)], lambda x: length(x))) AS before, unnest(range(len(found))) AS i FROM m WHERE len(found) > 0),
placed AS (SELECT *, sum(before) OVER w + sum(length(hit)) OVER w - length(hit) AS start FROM one WINDOW w AS (PARTITION BY r, k ORDER BY i)),
span AS (SELECT r, k, start, name || ':' || start::BIGINT || ':' || (start + length(hit))::BIGINT AS s FROM placed WHERE length(regexp_replace(hit, head, '')) >= least),
total AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, string_agg(s, ',' ORDER BY start, k) AS s FROM span GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256 FROM d LEFT JOIN total USING (r)
"""
