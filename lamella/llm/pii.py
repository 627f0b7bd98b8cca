"""Personal data: exact patterns, and candidates that boosted trees accept or refuse.

The patterns (e-mail and IP addresses, card and phone numbers; the base) run over a text's bytes, and their spans always count.
Generators of high recall then propose overlapping spans beside them: e-mail addresses spelled in words, IPv6 addresses, IBANs, cards
within longer runs of digits, phone numbers without a country code, national numbers. Each candidate has features of its format
(lengths, groups, separators, checksums, dates) and of its context (cue words of four languages before and behind it, what it touches).
Gradient-boosted trees score it, isotonic regression on held-out rows turns scores into probabilities, and each kind has the least
probability from which on held-out candidates are right with PRECISION. Of accepted spans that overlap the likeliest stays.

The trees are fitted on EXAMPLES made-up labelled texts (`pii_examples`; a third of them held out), a bound that is a parameter;
`fit` takes labelled texts of other origin as well. The model is a few kB and goes with the tasks.

Defined results: a null text is as an empty one, with no spans; rows are independent of each other, so repeated rows and ids give
equal rows; an empty table gives no rows; other columns are not read; a text takes time in proportion to its length, and a very long
one is one row of one task. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import boosting
from lamella.llm._common import cut, spread
from lamella.llm.pii_examples import examples

#: In order of the spans' names where they start together; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "email_words", "ip6", "iban", "card_part", "local_phone", "national_id")
BASE = 4
EXAMPLES, SEED, PRECISION = 12_000, 7, 0.97

# ---- the base

LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(rb"[0-9]")
DIGITS = b"0123456789"
_NOT_DIGITS = bytes(c for c in range(256) if c not in DIGITS)


def digits_of(text: bytes) -> bytes:
    return text.translate(None, _NOT_DIGITS)


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = c - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: bytes) -> bool:
    """Whether a number is 255 at most."""
    part = part.lstrip(b"0")
    return len(part) <= 3 and int(part or b"0") <= 255


def emails(text: bytes):
    """(start, end) of addresses, by their at signs: a run before one ends at the match or the at sign before it."""
    floor = 0
    at = text.find(b"@")
    while at >= 0:
        head = text[floor:at]
        start = floor + len(head.rstrip(LOCAL))
        floor = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        at = text.find(b"@", floor)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes; the first four of KINDS."""
    out = [(s, 0, e) for s, e in emails(text)] if b"@" in text else []
    if not DIGIT.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m.groups()))]
    for m in CARD.finditer(text):
        d = digits_of(m.group()) if m.end() - m.start() >= 12 else b""
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if b"+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


# ---- candidates

SPELLED = (b"(at)", b"[at]", b"{at}", b"<at>", b" at ", b" arroba ", b"(arroba)", b"(@)", b"[@]", b" @ ")
_AT = re.compile(rb"\x20?(?:[(\[{<]\x20?(?:at|arroba|@)\x20?[)\]}>]|\x20(?:at|arroba|@)(?=\x20))\x20?", re.I)
_HOST = re.compile(rb"[A-Za-z0-9-]{1,63}(?:(?:\x20?[(\[{<]\x20?(?:dot|punkt|point|punto|\.)\x20?[)\]}>]\x20?|\x20(?:dot|punkt|point|punto)\x20|\.)[A-Za-z0-9-]{2,63}){1,4}", re.I)
_HEX = b"0123456789abcdefABCDEF:"
_COLONS = re.compile(rb":[0-9A-Fa-f]{0,4}:")
_IBAN = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NUMBERS = re.compile(rb"(?:\(|(?<![0-9]))[0-9]++\)?(?:(?:[\x20./-]{1,2}\(?|(?<=\)))[0-9]++\)?)+")
_LONG = re.compile(rb"[0-9]{12,}")
_GROUP = re.compile(rb"\(?[0-9]+\)?")


def _groups(start: int, run: bytes, least: int, most: int):
    """Spans of neighbouring groups of a run of numbers with so many digits, up to eight groups."""
    groups = [(m.start(), m.end(), len(digits_of(m.group()))) for m in _GROUP.finditer(run)]
    for i in range(len(groups)):
        n = 0
        for j in range(i, min(i + 8, len(groups))):
            n += groups[j][2]
            if n > most:
                break
            if n >= least:
                yield start + groups[i][0], start + groups[j][1], j - i + 1


def candidates(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans that could be personal data of the further kinds, overlapping ones too."""
    out = []
    low = text.lower()
    if any(x in low for x in SPELLED):
        floor = 0
        for m in _AT.finditer(text):
            head = text[max(floor, m.start() - 64) : m.start()]
            start = m.start() - len(head) + len(head.rstrip(LOCAL))
            floor = m.end()
            if start < m.start() and (host := _HOST.match(text, m.end())):
                out.append((start, 4, host.end()))
    if not DIGIT.search(text):
        return out
    floor = 0
    for m in _COLONS.finditer(text):
        if m.start() >= floor:
            head = text[max(floor, m.start() - 5) : m.start()]
            start = m.start() - len(head) + len(head.rstrip(_HEX))
            tail = text[m.end() : m.end() + 45]
            floor = m.end() + len(tail) - len(tail.lstrip(_HEX))
            out.append((start, 5, floor - (text[floor - 1 : floor] == b":" and text[floor - 2 : floor] != b"::")))
    out += [(m.start(), 6, m.end()) for m in _IBAN.finditer(text)]
    for m in _NUMBERS.finditer(text):
        run = m.group()
        for s, e, _ in _groups(m.start(), run, 12, 19):
            out.append((s, 7, e))
        for s, e, n in _groups(m.start(), run, 7, 13):
            if n > 1:
                out.append((s, 8, e))
                if n <= 4 and e - s <= 14:
                    out.append((s, 9, e))
    out += [(m.start(), 7, m.end()) for m in _LONG.finditer(text) if m.end() - m.start() <= 19]
    return list(dict.fromkeys(out))


# ---- features

_CUES = tuple(re.compile(rb"(?<![a-z])(?:" + x + rb")") for x in (
    rb"tel|phone|call|fax|mobil|m\xc3\xb3vil|t\xc3\xa9l|rufen|ruf|llam|appel|whatsapp|sms|handy|number is|reach|dial",
    rb"e-?mail|mail|write|contact|kontakt|schreib|escrib|correo|adresse|\xc3\xa9cri|courriel|address",
    rb"iban|bank|konto|compte|cuenta|account|transfer|\xc3\xbcberweis|virement|bic|card|visa|karte|carte|tarjeta|credit",
    rb"ssn|social|passport|ausweis|dni|nir|nif|identity|national|s\xc3\xa9cu|seguro|steuer|tax id|versicherung",
    rb"order|invoice|page|version|isbn|date|fig|total|ticket|case|serial|part|model|ref|section|rev|release|bestell|commande|factura|pedido|seite|build|issn|doi|lot|sku|room|score|pp|item|chapter|article",
    rb"ip|host|server|addr|ping|node|dns|route|netz|r\xc3\xa9seau|gateway",
))
_UNITS = re.compile(rb"\s?(?:%|\xe2\x82\xac|\$|\xc2\xa3|kg|km|cm|mm|gb|mb|eur|usd|pts|points|pages|copies|items|hours|stunden|heures)")
_DATE = re.compile(rb"(?:(?:19|20)\d\d[-./\x20](?:0?[1-9]|1[0-2])[-./\x20](?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-./\x20](?:0?[1-9]|1[0-2])[-./\x20](?:19|20)?\d\d)")
_YEAR = re.compile(rb"(?<!\d)(?:19|20)\d\d(?!\d)")


def mod97(run: bytes) -> bool:
    code = run.replace(b" ", b"")
    return int("".join(str(int(chr(c), 36)) for c in code[4:] + code[:4])) % 97 == 1


def features(text: bytes, low: bytes, start: int, kind: int, end: int) -> list[float]:
    run = text[start:end]
    groups = [len(g) for g in re.findall(rb"[0-9]+", run)]
    d = digits_of(run)
    before, after = low[max(0, start - 48) : start], low[end : end + 24]
    near = [max((m.start() for m in c.finditer(before)), default=-1) for c in _CUES]
    left, right = text[start - 1 : start], text[end : end + 1]
    count = run.count
    return [
        *(float(kind == k) for k in range(BASE, len(KINDS))),
        len(run), len(d), len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        count(b" "), count(b"."), count(b"-"), count(b"/"), count(b":"), count(b"(") + count(b"["), count(b"::"),
        len({c for c in run if c in b" .-/"}), len(set(d)),
        float(len(d) > 1 and luhn(d)), float(kind == 6 and mod97(run)), float(d[:1] == b"0"), float(run[:1] == b"("),
        float(bool(_DATE.fullmatch(run))), len(_YEAR.findall(run)),
        sum(c in b"abcdefABCDEF" for c in run), sum(65 <= c <= 90 or 97 <= c <= 122 for c in run), float(b"at)" in low[start:end] or b"at]" in low[start:end] or b"at}" in low[start:end] or b"@" in run), float(bool(re.search(rb"[\s(\[](?:dot|punkt|point|punto)[\s)\]]", low[start:end]))),
        *((len(before) - p if p >= 0 else 99.0) for p in near),
        float(left.isalnum() or left in (b"-", b"_", b"/", b"+", b"#")), float(right.isalnum() or right in (b"-", b"_", b"/")), float(left in (b".", b",", b"=")) + 2 * float(left in (b"$", b"v")),
        float(bool(re.match(rb"[.,/-]\d", text[end : end + 2]))), float(bool(re.match(rb"\s?[-./(]?\d", text[end : end + 3]))), float(bool(re.search(rb"\d[-./)]?\s?$", text[max(0, start - 3) : start]))),
        float(bool(_UNITS.match(after))), max((int(g) > 255 for g in re.findall(rb"[0-9]{1,4}", run)), default=0),
    ]


# ---- the model


class Model:
    """Trees, the curve of probabilities of each kind, and its threshold."""

    def __init__(self, trees: boosting.Boosted, curves: dict, limits: dict):
        self.trees, self.curves, self.limits = trees, curves, limits

    def chances(self, x: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        margins, out = self.trees.margins(x), np.zeros(len(x))
        for k, curve in self.curves.items():
            out[kinds == k] = boosting.probability(curve, margins[kinds == k])
        return out


def free(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that touch no span of the base."""
    if not base or not spans:
        return spans
    taken = sorted((s, e) for s, _, e in base)
    starts, ends = np.array([s for s, _ in taken]), np.maximum.accumulate([e for _, e in taken])
    before = np.searchsorted(starts, [e for _, _, e in spans]) - 1
    return [x for x, b in zip(spans, before.tolist(), strict=True) if b < 0 or ends[b] <= x[0]]


def table(texts: list[bytes], of: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    rows, kinds = [], []
    for t, spans in zip(texts, of, strict=True):
        low = t.lower() if spans else b""
        rows += [features(t, low, *x) for x in spans]
        kinds += [k for _, k, _ in spans]
    return np.array(rows, dtype=np.float64) if rows else np.zeros((0, 1)), np.array(kinds, dtype=np.int64)


def fit(labelled: list[tuple[str, list[tuple[int, int, str]]]], precision: float = PRECISION) -> Model:
    """A model of texts with the spans (start and end in code points, kind) that are personal data; a third of the texts calibrates it."""
    texts, of, right = [], [], []
    for text, spans in labelled:
        t = text.encode()
        true = {(len(text[:s].encode()), KINDS.index(k), len(text[:e].encode())) for s, e, k in spans}
        found = free(candidates(t), base_spans(t))
        texts.append(t)
        of.append(found)
        right.append([x in true for x in found])
    x, kinds = table(texts, of)
    y = np.array([v for r in right for v in r], dtype=np.float64)
    held = np.repeat(np.arange(len(texts)) % 3 == 2, [len(f) for f in of])
    trees = boosting.Boosted().fit(x[~held], y[~held])
    margins, curves, limits = trees.margins(x[held]), {}, {}
    for k in range(BASE, len(KINDS)):
        own = kinds[held] == k
        if own.any():
            curves[k] = boosting.isotonic(margins[own], y[held][own])
            limits[k] = boosting.threshold(boosting.probability(curves[k], margins[own]), y[held][own], precision)
    return Model(trees, curves, limits)


@lru_cache(maxsize=4)
def default_model(n: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION) -> Model:
    return fit(examples(n, seed), precision)


def accepted(texts: list[bytes], bases: list[list[tuple[int, int, int]]], model: Model) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, probability) of what the model adds to each text, without overlaps."""
    of = [free(candidates(t), b) for t, b in zip(texts, bases, strict=True)]
    x, kinds = table(texts, of)
    chances = model.chances(x, kinds) if len(x) else np.zeros(0)
    out, at = [], 0
    for spans in of:
        likely = [(*s, float(p)) for s, p in zip(spans, chances[at : at + len(spans)], strict=True) if p >= model.limits.get(s[1], 2)]
        at += len(spans)
        likely.sort(key=lambda s: (-s[3], s[0] - s[2], s[0], s[1]))  # the likeliest first, then the longest
        kept: list[tuple[int, int, int, float]] = []  # by their starts; none overlaps another
        for x in likely:
            at_ = bisect_left(kept, x)
            if (at_ == 0 or kept[at_ - 1][2] <= x[0]) and (at_ == len(kept) or x[2] <= kept[at_][0]):
                kept.insert(at_, x)
        out.append(kept)
    return out


# ---- over tables


def _named(text: bytes, spans: list[tuple[int, int, int]]) -> list[str]:
    """kind:start:end in code points, by start, then kind."""
    spans = sorted(spans)
    if spans and not text.isascii():
        before = np.concatenate(([0], np.cumsum(np.frombuffer(text, dtype=np.uint8) & 0xC0 != 0x80)))
        spans = [(int(before[s]), k, int(before[e])) for s, k, e in spans]
    return [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone (of the base), n_added, base_sha256 and spans of every whole text."""
    model = model or default_model()

    def run(batches):
        for b in cut(batches, 1):
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            added = accepted(texts, bases, model)
            counts = [pa.array([sum(x[1] == k for x in base) for base in bases], pa.int64()) for k in range(BASE)]
            digests = [hashlib.sha256(",".join(_named(t, base)).encode()).hexdigest() for t, base in zip(texts, bases, strict=True)]
            spans = [",".join(_named(t, base + [s[:3] for s in more])) for t, base, more in zip(texts, bases, added, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(list(map(len, added)), pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_added bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """id_col and every text with [KIND] in place of its spans; spans that overlap become one, named by the first."""
    model = model or default_model()

    def redacted(text: bytes, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for s, k, e in sorted(spans):
            if s >= at:
                out += [text[at:s], b"[" + KINDS[k].upper().encode() + b"]"]
            at = max(at, e)
        return b"".join([*out, text[at:]]).decode()

    def run(batches):
        for b in cut(batches, 1):
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            added = accepted(texts, bases, model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([redacted(t, base + [s[:3] for s in more]) for t, base, more in zip(texts, bases, added, strict=True)], pa.string())], names=[id_col, "redacted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"`{id_col}` {kind}, redacted string")


#: The base columns in DuckDB's SQL, over whole texts. A match's place follows from the pieces between matches, and the matches before it.
BASE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
kind AS (SELECT * FROM (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
  (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) k(k, name, pattern)),
m AS (SELECT r, k, name, regexp_extract_all(t, pattern) AS found, string_split_regex(t, pattern) AS between_ FROM d, kind),
one AS (SELECT r, k, name, unnest(found) AS hit, unnest(list_transform(between_[1 : len(found)], lambda x: length(x))) AS before, unnest(range(len(found))) AS i FROM m WHERE len(found) > 0),
placed AS (SELECT *, sum(before) OVER w + sum(length(hit)) OVER w - length(hit) AS start, regexp_replace(hit, '[^0-9]', '', 'g') AS g FROM one WINDOW w AS (PARTITION BY r, k ORDER BY i)),
span AS (SELECT r, k, start, name || ':' || start::BIGINT || ':' || (start + length(hit))::BIGINT AS s FROM placed WHERE CASE k WHEN 0 THEN true
  WHEN 1 THEN len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR ('0' || right(ltrim(x, '0'), 3))::BIGINT > 255)) = 0
  WHEN 2 THEN length(g) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(g)), lambda j: CASE WHEN j % 2 = 0 THEN substr(g, (length(g) - j)::BIGINT, 1)::BIGINT
    ELSE 2 * substr(g, (length(g) - j)::BIGINT, 1)::BIGINT - CASE WHEN substr(g, (length(g) - j)::BIGINT, 1)::BIGINT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  ELSE length(g) BETWEEN 9 AND 15 END),
total AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, count(*) FILTER (k = 3) AS e, string_agg(s, ',' ORDER BY start, k) AS s FROM span GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_email, coalesce(b, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(e, 0) AS n_phone, sha256(coalesce(s, '')) AS base_sha256 FROM d LEFT JOIN total USING (r)
"""
