"""Quality classifier without hand labels: heuristic labellers, a weak-label model, and a hashed linear scorer.

Each labeller votes good (1), bad (-1) or not at all (0) on a whole text. How votes combine over all documents is counted (at
most 3^len(LABELLERS) patterns reach the driver), and expectation maximisation fits how often each labeller votes good on
good and on bad documents and how many documents are good. The posterior labels of a bounded sample (MAX_DOCS documents by a
hash of the id) train a logistic scorer over hashed features, which then scores every document.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import in_sample
from .worker import let_go

MAX_DOCS = 20_000
BITS = 16


def _table(kind) -> bytes:
    return bytes(ord(kind(chr(i))) for i in range(256))


#: Latin-1 text with X for capitals, x for other letters and 9 for digits; white space and marks stay.
_KINDS = _table(lambda c: "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else " " if c == "\xa0" else c)
_PLAIN = b"Xx9 \t\n\r\x0b\x0c_.,;:'\"()?-"
_MARKS = bytes(set(range(33, 127)) - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123)) - set(_PLAIN)) + bytes(set(range(161, 192)) - {170, 181, 186}) + b"\xd7\xf7"
#: Letters beyond Latin-1 count as small letters.
codecs.register_error("pointloom-letters", lambda e: ("x" * (e.end - e.start), e.end))


def kinds(text: str) -> bytes:
    return text.encode("latin-1", "pointloom-letters").translate(_KINDS)


def signals(text: str | None) -> tuple[dict[str, float], Counter]:
    """Measures of a whole text that the labellers and the scorer look at, and how often each shape of word occurs."""
    text = text or ""
    shapes, words = kinds(text), text.split()
    n, size = len(words), max(1, len(text))
    counts, tokens = Counter(words), Counter(shapes.split())
    lines = [x for x in text.split("\n") if x.strip()]
    upper, lower = shapes.count(b"X"), shapes.count(b"x")
    of = lambda test: sum(c for w, c in tokens.items() if test(w)) / max(1, n)
    return {
        "words": n,
        "marks": (len(shapes) - len(shapes.translate(None, _MARKS))) / size,
        "upper": upper / max(1, upper + lower),
        "tails": of(lambda w: len(w) > 1 and w[-1] in _MARKS and w[-2] in _MARKS),
        "pairs": 1 - len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 0.0,
        "again": sum(map(eq, words, words[1:])) / (n - 1) if n > 1 else 0.0,
        "top": max(counts.values()) / n if n else 0.0,
        "lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "n_lines": len(lines),
        "ends": of(lambda w: w[-1] in b".!?"),
        "length": sum(len(w) * c for w, c in tokens.items()) / max(1, n),
        "wordless": of(lambda w: b"x" not in w and b"X" not in w and b"9" not in w),
    }, tokens


def _between(good: float, bad: float):
    return lambda x: 1 if x <= good else -1 if x >= bad else 0


LABELLERS = {
    "few marks": lambda s: _between(0.01, 0.04)(s["marks"]),
    "lower case": lambda s: _between(0.12, 0.3)(s["upper"]) if s["words"] >= 5 else 0,
    "plain word ends": lambda s: _between(0.03, 0.2)(s["tails"]),
    "new word pairs": lambda s: _between(0.3, 0.55)(s["pairs"]) if s["words"] >= 40 else 0,
    "no stutter": lambda s: _between(0.05, 0.3)(s["again"]) if s["words"] >= 20 else 0,
    "no main word": lambda s: _between(0.15, 0.3)(s["top"]) if s["words"] >= 40 else 0,
    "new lines": lambda s: _between(0.2, 0.5)(s["lines"]) if s["n_lines"] >= 5 else 0,
    "sentences": lambda s: (1 if 0.015 <= s["ends"] <= 0.5 else -1) if s["words"] >= 80 else 0,
    "word length": lambda s: (1 if 2 <= s["length"] <= 14 else -1) if s["words"] >= 5 else 0,
    "tokens are words": lambda s: _between(0.05, 0.2)(s["wordless"]),
    "not empty": lambda s: 1 if s["words"] >= 3 else -1 if s["words"] == 0 else 0,
}


def votes(s: dict[str, float]) -> list[int]:
    return [f(s) for f in LABELLERS.values()]


@dataclass
class WeakLabels:
    """``good[i]``, ``bad[i]``: the chance that labeller i votes good on a good, a bad document, if it votes."""

    good: np.ndarray
    bad: np.ndarray
    share: float

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """The chance that a document with these votes is good."""
        up, down = (v > 0).astype(float), (v < 0).astype(float)
        odds = up @ (np.log(self.good) - np.log(self.bad)) + down @ (np.log1p(-self.good) - np.log1p(-self.bad)) + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_weak_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> WeakLabels:
    """Expectation maximisation from the start that a document with a bad vote is likely bad."""
    up, down = (patterns > 0).astype(float), (patterns < 0).astype(float)
    post = np.where(down.any(axis=1), 0.1, 0.95)
    model = WeakLabels(np.full(patterns.shape[1], 0.9), np.full(patterns.shape[1], 0.5), 0.8)
    for _ in range(rounds):
        g, b = counts * post, counts * (1 - post)
        good = (g @ up + 1.8) / (g @ (up + down) + 2)
        bad = (b @ up + 1) / (b @ (up + down) + 2)
        # a labeller is never taken to say the opposite of what it says
        model = WeakLabels(np.clip(np.maximum(good, bad), 0.01, 0.999), np.clip(np.minimum(good, bad), 0.001, 0.99), float(np.clip((g.sum() + 1) / (counts.sum() + 2), 0.01, 0.99)))
        post = model.posterior(patterns)
    return model


class _Shapes(dict):
    """The hashed number of a word's shape: runs of capitals, small letters, digits and each mark, + for more than one."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        n = xxhash.xxh32_intdigest(re.sub(rb"(?s)(.)\1+", rb"\1+", word), 1) >> (32 - BITS)
        # a long word is not held, but its shape is that of the whole word
        if len(word) <= 64:
            self[word] = n
        return n


def hashed(s: dict[str, float], tokens: Counter, shapes: _Shapes) -> tuple[list[int], list[float]]:
    """Numbers and values of a text's features: square roots of the shares of word shapes, and the signals in steps."""
    shares: dict[int, int] = {}
    for w, c in tokens.items():
        k = shapes[w]
        shares[k] = shares.get(k, 0) + c
    total = max(1, sum(shares.values()))
    idx, val = list(shares), [(c / total) ** 0.5 for c in shares.values()]
    for name in ("marks", "upper", "tails", "pairs", "again", "top", "lines", "ends", "wordless"):
        step = int(min(19, s[name] * 20)) if name != "marks" else int(min(19, s[name] * 100))
        size = "short" if s["words"] < 40 else "long"
        idx.append(xxhash.xxh32_intdigest(f"{name} {step} {size}", 2) >> (32 - BITS))
        val.append(1.0)
    return idx, val


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes of each document as a number in base 3, counted; with a mark for sampled documents, also the features."""
    let_go()
    shapes = _Shapes()
    for batch in batches:
        ks, sampled, idx, val = [], batch.column(1).to_pylist(), [], []
        for x, keep in zip(batch.column(0), sampled):
            text = x.as_py()
            s, tokens = signals(text)
            ks.append(sum((v + 1) * 3**i for i, v in enumerate(votes(s))))
            a, b = hashed(s, tokens, shapes) if keep else (None, None)
            idx.append(a)
            val.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float64()))], ["pattern", "idx", "val"])


def _unpack(ks: np.ndarray) -> np.ndarray:
    return np.stack([ks // 3**i % 3 - 1 for i in range(len(LABELLERS))], axis=1) if len(ks) else np.zeros((0, len(LABELLERS)))


@dataclass
class QualityModel:
    weak: WeakLabels
    weights: np.ndarray
    bias: float

    def score(self, text: str | None, shapes: _Shapes) -> float:
        idx, val = hashed(*signals(text), shapes)
        return float(1 / (1 + np.exp(-np.clip(self.weights[idx] @ np.array(val) + self.bias, -500, 500))))


def fit_quality(docs: DataFrame, scratch, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, l2: float = 1e-4, rounds: int = 150) -> QualityModel:
    """Votes over all documents, the weak-label model, and the scorer from the sample's posterior labels."""
    n = docs.count()
    rows = docs.select(F.col(text_col).alias("text"), in_sample(F.col(id_col), n, max_docs).alias("sampled"))
    rows = scratch.save(rows.mapInArrow(_patterns, "pattern long, idx array<int>, val array<double>"))
    counted = rows.groupBy("pattern").count().collect()
    patterns = _unpack(np.array([r["pattern"] for r in counted], np.int64))
    weak = fit_weak_labels(patterns, np.array([r["count"] for r in counted], np.float64)) if counted else WeakLabels(np.full(len(LABELLERS), 0.9), np.full(len(LABELLERS), 0.5), 0.5)
    # the sample, equal rows as one with their number
    sample = rows.filter("idx is not null").groupBy("pattern", "idx", "val").count().toArrow().to_pylist()
    scratch.drop(rows)
    weights, bias = np.zeros(1 << BITS), 0.0
    if sample:
        y = weak.posterior(_unpack(np.array([r["pattern"] for r in sample], np.int64)))
        c = np.array([r["count"] for r in sample], np.float64)
        c /= c.sum()
        at = np.repeat(np.arange(len(sample)), [len(r["idx"]) for r in sample])
        idx, val = np.concatenate([r["idx"] for r in sample]).astype(np.int64), np.concatenate([r["val"] for r in sample])
        square, square_b = np.full(1 << BITS, 1e-8), 1e-8
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(at, val * weights[idx], minlength=len(sample)) + bias, -500, 500)))
            r = c * (y - p)
            g, gb = np.bincount(idx, val * r[at], minlength=1 << BITS) - l2 * weights, r.sum()
            square, square_b = square + g**2, square_b + gb**2
            weights, bias = weights + 0.5 * g / np.sqrt(square), bias + 0.5 * gb / np.sqrt(square_b)
    return QualityModel(weak, weights, float(bias))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        m, shapes = model.value, _Shapes()
        for batch in batches:
            out, weak = [], []
            for x in batch.column(1):
                text = x.as_py()
                s, tokens = signals(text)
                idx, val = hashed(s, tokens, shapes)
                out.append(float(m.weights[idx] @ np.array(val) + m.bias))
                weak.append(votes(s))
            score = 1 / (1 + np.exp(-np.clip(np.array(out), -500, 500)))
            post = m.weak.posterior(np.array(weak, np.float64).reshape(-1, len(LABELLERS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(post), pa.array(score >= 0.5)], ["id", "score", "posterior", "kept"])

    return run


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: QualityModel | None = None, scratch=None) -> DataFrame:
    """A row for each row: id, ``score`` (chance that the text is good), ``posterior`` (of its votes alone), ``kept`` (score >= 0.5).

    A null or blank text has no words and is scored as such (the labellers call it bad). Texts and words of any length are scored
    whole. Rows that repeat get the same score; extra columns are ignored, whatever their names; an empty table gives an empty one.
    """
    from .scratch import Scratch

    model = model or fit_quality(docs, scratch or Scratch(docs.sparkSession), id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_score(shared), f"id {kind}, score double, posterior double, kept boolean").withColumnRenamed("id", id_col)


def _keep(model, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        m, shapes = model.value, _Shapes()
        for batch in batches:
            at = batch.schema.get_field_index(column)
            yield batch.filter(pa.array([m.score(x.as_py(), shapes) >= 0.5 for x in batch.column(at)], pa.bool_()))

    return run


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: QualityModel | None = None, scratch=None) -> DataFrame:
    """The rows, with all their columns, whose text scores 0.5 or more.

    Null and blank texts are scored as texts without words; a null id is an id like others; rows that repeat go or stay together;
    an empty table gives an empty one.
    """
    from .scratch import Scratch

    model = model or fit_quality(docs, scratch or Scratch(docs.sparkSession), id_col, text_col)
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model), text_col), docs.schema)
