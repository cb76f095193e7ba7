"""Personal data by a semi-Markov conditional random field over whole candidate spans, on top of four exact patterns.

Text away from digits and @ can't hold an entity, so the field is decoded on regions: runs of tokens with a digit or @, with a
token of context. A region is cut into atoms (runs of ASCII letters and digits, runs of white space, single other characters).
Every span of up to MAX_ATOMS atoms is a candidate for every type, scored as a whole by its shape; the dynamic programme over
the atoms picks spans and types together. The score of a region's empty labelling is 0, so regions are independent.

The field is fitted by likelihood on a bounded sample of regions that are labelled by the base patterns and by SEEDS: of some
MAX_DOCS documents, for each set of kinds that a region holds, PER_LABEL different shapes in the order of a hash, so that rare
kinds and rare shapes have their part. Regions are cut at white space into parts of PART characters there; a longer part without
white space isn't used to fit. Decoding takes every whole text. Base spans always stay; the field's spans are added where they
touch no base span.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import in_sample
from .scratch import small_batches
from .worker import let_go

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
MAX_ATOMS = 16
MAX_DOCS = 20_000
PER_LABEL = 100
PART = 200
#: Boundaries scored at a time, and scored spans that a worker holds.
STEP, HELD = 512, 30_000

# The base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Marks of secrets, for the sample's labels alone.
SEEDS = re.compile(r"AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{12,}|(?<=token = \")[0-9a-f]{16,}")

_TRIGGER = re.compile(r"[0-9@]")
_MORE = re.compile(r"[ \t]{1,2}(?:[^\s0-9@]{0,3}[0-9@])\S*")
_TOKEN = re.compile(r"\S*")
_ATOM = re.compile(r"[A-Za-z0-9]+|\s+|[^A-Za-z0-9\s]")


def luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return sum(back[::2]) % 10 == (-sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four patterns by start, then kind as listed; each kind leftmost and without overlap."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            last = m.end()
            out.append((start, last, "email"))
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Spans of text that can hold an entity: each token with a digit or @, those like it that follow, and a little before."""
    done, n = 0, len(text)
    m = _TRIGGER.search(text)
    while m:
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        # what stands before, as far as it introduces a value
        lead = start
        while lead > done and text[lead - 1] in " =\"':":
            lead -= 1
        if lead < start and any(c in "=:" for c in text[lead:start]):
            while lead > done and not text[lead - 1].isspace():
                lead -= 1
            start = lead
        end = _TOKEN.match(text, m.start()).end()
        while more := _MORE.match(text, end):
            end = more.end()
        yield start, end
        done = end
        m = _TRIGGER.search(text, end) if end < n else None


_IP_SHAPE = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_EMAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_HEX = re.compile(r"[0-9a-f]+")
_KEY = re.compile(r"[A-Z0-9]+")
NAMES = ("bias", "email shape", "two @", "ip shape", "ip parts", "luhn", "card digits", "digits and breaks", "plus", "phone digits", "phone characters", "few digits", "many digits", "letters", "no digit", "white space", "cuts left", "cuts right", "goes on", "hex", "hex long", "key", "key long", "after =", "after quote", "long word", "edge mark", "dot", "breaks twice")


def features(text: str, i: int, j: int) -> list[float]:
    """Of the whole span text[i:j] and the characters beside it."""
    s = text[i:j]
    digits = [c for c in s if "0" <= c <= "9"]
    d, letters = len(digits), sum(c.isalpha() for c in s)
    only = all(c in "0123456789 -" for c in s)
    left, right = text[i - 1] if i else " ", text[j] if j < len(text) else " "
    ip = bool(_IP_SHAPE.fullmatch(s))
    word = s.isalnum() and s.isascii()
    mixed = word and d >= 2 and letters >= 1
    return [
        1.0, bool(_EMAIL_SHAPE.fullmatch(s)), s.count("@") > 1, ip, ip and all(int(p) <= 255 for p in s.split(".")),
        only and 12 <= d <= 19 and luhn("".join(digits)), only and 12 <= d <= 19, only, s[0] == "+", 9 <= d <= 15,
        s[0] == "+" and all(c in "+ ().0123456789-" for c in s), d <= 6, d > 19, letters > 0, d == 0, any(c.isspace() for c in s),
        left.isalnum() and s[0].isalnum(), right.isalnum() and s[-1].isalnum(), (left in "@.-+(" and left != " ") or (right in "@-" and right != " "),
        mixed and bool(_HEX.fullmatch(s)), mixed and len(s) >= 16 and bool(_HEX.fullmatch(s)), mixed and bool(_KEY.fullmatch(s)), mixed and len(s) == 20 and bool(_KEY.fullmatch(s)),
        left == "=" or text[max(0, i - 2) : i] == "= ", left in "\"'", len(s) >= 12 and word, not (s[0].isalnum() or s[0] == "+") or not s[-1].isalnum(), "." in s, "--" in s or "  " in s,
    ]


class SemiMarkov:
    """Weights for every feature and type; a labelling's score is the sum over its spans."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros((len(NAMES), len(KINDS))) if weights is None else weights
        self.known: dict[tuple[str, str, str], tuple[float, int]] = {}

    @staticmethod
    def candidates(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int]], np.ndarray]:
        """Atom boundaries, candidate spans as pairs of boundary numbers ordered by end, and their features."""
        bounds = [m.start() for m in _ATOM.finditer(text, start, end)] + [end]
        space = [text[b].isspace() for b in bounds[:-1]]
        spans = [(a, b) for b in range(1, len(bounds)) if not space[b - 1] for a in range(max(0, b - MAX_ATOMS), b) if not space[a]]
        rows = [features(text, bounds[a], bounds[b]) for a, b in spans]
        return bounds, spans, np.array(rows, np.float64).reshape(-1, len(NAMES))

    def decode(self, text: str, start: int, end: int) -> list[tuple[int, int, str]]:
        """The labelling with the highest score. Spans are scored STEP boundaries at a time, and those met before aren't scored
        again, so that a long region costs memory by its atoms alone."""
        bounds = [m.start() for m in _ATOM.finditer(text, start, end)] + [end]
        space = [text[b].isspace() for b in bounds[:-1]]
        best, back = [0.0] * len(bounds), [(-1, 0)] * len(bounds)
        known = self.known
        for first in range(1, len(bounds), STEP):
            if len(known) > HELD:
                known.clear()
            spans, fresh = [], {}
            for b in range(first, min(first + STEP, len(bounds))):
                if space[b - 1]:
                    continue
                j = bounds[b]
                for a in range(max(0, b - MAX_ATOMS), b):
                    if not space[a]:
                        i = bounds[a]
                        # all that features() looks at
                        key = (text[max(0, i - 2) : i], text[i:j], text[j : j + 1])
                        spans.append((a, b, key))
                        if key not in known and key not in fresh:
                            fresh[key] = (i, j)
            if fresh:
                scores = np.array([features(text, i, j) for i, j in fresh.values()], np.float64) @ self.weights
                known.update(zip(fresh, zip(scores.max(axis=1).tolist(), scores.argmax(axis=1).tolist())))
            at = 0
            for b in range(first, min(first + STEP, len(bounds))):
                best[b] = best[b - 1]
                while at < len(spans) and spans[at][1] == b:
                    a, _, key = spans[at]
                    score, kind = known[key]
                    if (s := best[a] + score) > best[b]:
                        best[b], back[b] = s, (a, kind)
                    at += 1
        out, b = [], len(bounds) - 1
        while b:
            a, kind = back[b]
            if a >= 0 and best[b] > best[b - 1]:
                out.append((bounds[a], bounds[b], KINDS[kind]))
                b = a
            else:
                b -= 1
        return out[::-1]

    def fit(self, texts: list[str], steps: int = 60, rate: float = 0.5, l2: float = 1e-3) -> SemiMarkov:
        """Ascent on the log-likelihood of the labels of these regions."""
        data = []
        for text in texts:
            bounds, spans, x = self.candidates(text, 0, len(text))
            where, gold, last = {(bounds[a], bounds[b]): n for n, (a, b) in enumerate(spans)}, np.zeros((len(spans), len(KINDS))), 0
            for i, j, k in gold_spans(text):
                if i >= last and (i, j) in where:
                    gold[where[i, j], KINDS.index(k)], last = 1, j
            if spans:
                data.append((len(bounds), spans, x, gold))
        square = np.full_like(self.weights, 1e-6)
        for _ in range(steps if data else 0):
            slope = -l2 * self.weights * len(data)
            for n, spans, x, gold in data:
                slope += x.T @ (gold - self._expected(n, spans, x @ self.weights))
            square += slope**2
            self.weights = self.weights + rate * slope / np.sqrt(square)
        self.known.clear()
        return self

    @staticmethod
    def _expected(n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
        """The probability of each span and type, by the forward and backward sums over labellings."""
        top = scores.max(axis=1, keepdims=True)
        total = (top[:, 0] + np.log(np.exp(scores - top).sum(axis=1))).tolist()
        ends: list[list[int]] = [[] for _ in range(n)]
        for k, (_, b) in enumerate(spans):
            ends[b].append(k)

        def lse(v: list[float]) -> float:
            m = max(v)
            return m + math.log(sum(math.exp(a - m) for a in v))

        forward, backward = [0.0] * n, [[] for _ in range(n)]
        for b in range(1, n):
            forward[b] = lse([forward[b - 1], *(forward[spans[k][0]] + total[k] for k in ends[b])])
        after = [0.0] * n
        for b in range(n - 1, -1, -1):
            if b < n - 1:
                after[b] = lse([after[b + 1], *backward[b]])
            for k in ends[b]:
                backward[spans[k][0]].append(total[k] + after[b])
        base = np.array([forward[a] + after[b] - forward[-1] for a, b in spans])
        return np.exp(scores + base[:, None])


def _parts(region: str, size: int = PART) -> Iterator[str]:
    """A region cut at white space into parts of ``size`` characters at most; longer ones are left out."""
    part = ""
    for piece in re.findall(r"\s*\S+", region):
        if part and len(part) + len(piece) > size:
            yield part.strip()
            part = ""
        if len(piece.strip()) <= size:
            part += piece
        elif part:
            yield part.strip()
            part = ""
    if part:
        yield part.strip()


def gold_spans(text: str) -> list[tuple[int, int, str]]:
    """What the base patterns and SEEDS find, by start, the longest first."""
    return sorted([*base_spans(text), *((m.start(), m.end(), "secret") for m in SEEDS.finditer(text))], key=lambda s: (s[0], -s[1]))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        out = [part for x in batch.column(0) if (text := x.as_py()) for a, b in regions(text) for part in _parts(text[a:b])]
        labels = [" ".join(sorted({k for _, _, k in gold_spans(part)})) for part in out]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(labels, pa.string())], ["region", "label"])


def fit_field(docs: DataFrame, id_col: str, text_col: str, max_docs: int = MAX_DOCS, per_label: int = PER_LABEL) -> SemiMarkov:
    """A field fitted on the regions of some ``max_docs`` documents, ``per_label`` shapes of each set of kinds."""
    small_batches(docs.sparkSession)
    picked = docs.filter(in_sample(F.col(id_col), docs.count(), max_docs))
    found = picked.select(text_col).mapInArrow(_sample, "region string, label string")
    shape = F.regexp_replace("region", "[0-9a-f]*[0-9][0-9a-f]{11,}", "h")
    shape = F.regexp_replace(F.regexp_replace(shape, "[0-9]", "9"), "[a-z]+", "a")
    shapes = found.groupBy("label", shape.alias("shape")).agg(F.min("region").alias("region"))
    ranked = shapes.selectExpr("label", "shape", "region", "row_number() over (partition by label order by xxhash64(shape), shape) as nth")
    rows = ranked.filter(F.col("nth") <= per_label).orderBy("label", "nth").collect()
    return SemiMarkov().fit([r["region"] for r in rows])


def all_spans(text: str | None, field: SemiMarkov) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans of a whole text; the field's spans don't touch a base span."""
    if not text:
        return [], []
    base = base_spans(text)
    spans = list(base)
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    for start, end in regions(text):
        for span in field.decode(text, start, end):
            # of the base spans that begin before its end none may reach beyond its start
            before = bisect_left(starts, span[1])
            if not before or reach[before - 1] <= span[0]:
                spans.append(span)
    return base, sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _find(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        field = SemiMarkov(weights)
        for batch in batches:
            rows = [all_spans(x.as_py(), field) for x in batch.column(1)]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in rows], pa.int64()) for k in BASE]
            sha = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([_joined(s) for _, s in rows], pa.string())], ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: SemiMarkov | None = None) -> DataFrame:
    """A row for each row: id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans), ``base_sha256`` and ``spans``.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined by commas. The field adds the kind
    ``secret`` and spans like the base kinds that the patterns miss; these are in ``spans`` only. A null or empty text has none.
    Texts are searched whole, however long. Rows that repeat and null ids pass as they are; extra columns are left out; an empty
    table gives an empty one.
    """
    field = field or fit_field(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_find(field.weights), f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def _mask(weights, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        field = SemiMarkov(weights)
        for batch in batches:
            at = batch.schema.get_field_index(column)
            out = []
            for x in batch.column(at):
                text = x.as_py()
                parts, last = [], 0
                for a, b, k in all_spans(text, field)[1]:
                    if b > last:
                        parts += [text[last : max(a, last)], f"<{k}>" if a >= last else ""]
                        last = b
                out.append("".join([*parts, text[last:]]) if parts else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return run


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: SemiMarkov | None = None) -> DataFrame:
    """The same rows and columns with every span in the text replaced by its kind in angle brackets; other rows unchanged.

    Null and empty texts stay as they are, and so do rows that repeat, null ids and all other columns, whatever their names; an
    empty table gives an empty one.
    """
    field = field or fit_field(docs, id_col, text_col)
    return docs.mapInArrow(_mask(field.weights, text_col), docs.schema)
