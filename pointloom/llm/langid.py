"""Language ID by unigram pieces with the segmentation summed out.

Every language has probabilities over the letter pieces of a fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces (the forward algorithm), not that of the best one; a text's is the product over its words.
Words are runs of letters in lower case; a run of more than SPAN letters is scored whole, as words of SPAN letters one after the
other. The pieces' probabilities are fitted by expectation maximisation over all segmentations (forward and backward) of all
words of a bounded sample: some MAX_DOCS documents of each language by a hash of the id.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import hash_limit

SPAN = 24
MAX_DOCS = 2000
ROUNDS = 3
_RUNS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """Runs of letters in lower case, cut after every SPAN letters."""
    out = []
    for run in _RUNS.findall(text.lower()) if text else ():
        if len(run) <= SPAN and run.isalpha():
            out.append(run)
            continue
        # \w has numerals that are neither letters nor decimal digits, such as superscripts, fractions and Roman numerals
        for part in "".join(c if c.isalpha() else " " for c in run).split():
            out += [part[i : i + SPAN] for i in range(0, len(part), SPAN)]
    return out


def vocabulary(path: str) -> dict[str, int]:
    """Piece -> number, from 1: pieces of letters, the mark of a word's start in front or not. 0 is any other single letter."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    kept = sorted({p.lower() for p in pieces if p.removeprefix("▁").isalpha() or p == "▁"})
    return {p: i + 1 for i, p in enumerate(kept)}


def with_prefixes(pieces: dict[str, int]) -> dict[str, int]:
    """The pieces, and -1 for what is only the beginning of one."""
    out = {p[:k]: -1 for p in pieces for k in range(1, len(p))}
    return out | pieces


class Lattice:
    """Words of one length and, for each end and piece length, which words have a piece there and its number."""

    def __init__(self, words: list[str], known: dict[str, int]):
        self.n, self.size = len(words[0]) + 1, len(words)
        n = self.n
        found: list[tuple[list[int], list[int]]] = [([], []) for _ in range((n + 1) * (n + 1))]
        get = known.get
        for row, word in enumerate(words):
            marked = "▁" + word
            for start in range(n):
                number = get(marked[start])
                at = found[(start + 1) * (n + 1) + 1]
                at[0].append(row)
                at[1].append(number if number is not None and number > 0 else 0)
                if number is None:
                    continue
                for end in range(start + 2, n + 1):
                    number = get(marked[start:end])
                    if number is None:
                        break
                    if number > 0:
                        at = found[end * (n + 1) + end - start]
                        at[0].append(row)
                        at[1].append(number)
        self.steps = [(*divmod(i, n + 1), np.array(rows), np.array(ids)) for i, (rows, ids) in enumerate(found) if rows]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """(n + 1, words, languages): the sums over segmentations up to each place."""
        a = np.zeros((self.n + 1, self.size, p.shape[1]))
        a[0] = 1
        for end, k, rows, ids in self.steps:
            a[end, rows] += a[end - k, rows] * p[ids]
        return a

    def backward(self, p: np.ndarray) -> np.ndarray:
        b = np.zeros((self.n + 1, self.size, p.shape[1]))
        b[self.n] = 1
        for end, k, rows, ids in reversed(self.steps):
            b[end - k, rows] += b[end, rows] * p[ids]
        return b


@dataclass
class LanguageModel:
    """``p``: a row for each piece (0 for other letters), a column for each language."""

    langs: list[str]
    pieces: dict[str, int]
    p: np.ndarray
    prior: np.ndarray
    known: dict[str, int] | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = np.zeros((len(words), len(self.langs)))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        known = with_prefixes(self.pieces) if self.known is None else self.known
        self.known = known
        for at in by_length.values():
            for k in range(0, len(at), 4096):
                own = at[k : k + 4096]
                out[own] = np.log(np.maximum(Lattice([words[i] for i in own], known).forward(self.p)[-1], 1e-300))
        return out


def train(words: dict[str, dict[str, int]], pieces: dict[str, int], prior: dict[str, float], rounds: int = ROUNDS, smooth: float = 0.02) -> LanguageModel:
    """A model from the word counts of each language, by expectation maximisation from equal probabilities."""
    langs = sorted(words)
    known = with_prefixes(pieces)
    size = len(pieces) + 1
    p = np.full((size, len(langs)), 1.0 / size)
    p[0] = 1e-3 / size
    for column, lang in enumerate(langs):
        by_length: dict[int, list[str]] = {}
        for w in words[lang]:
            by_length.setdefault(len(w), []).append(w)
        data = [(Lattice(ws, known), np.array([words[lang][w] for w in ws], np.float64)) for ws in by_length.values()]
        q = p[:, [column]]
        for _ in range(rounds):
            counts = np.zeros(size)
            for lattice, n in data:
                a, b = lattice.forward(q), lattice.backward(q)
                z = np.maximum(a[-1, :, 0], 1e-300)
                for end, k, rows, ids in lattice.steps:
                    counts += np.bincount(ids, a[end - k, rows, 0] * q[ids, 0] * b[end, rows, 0] / z[rows] * n[rows], minlength=size)
            q = ((counts + smooth) / (counts.sum() + smooth * size))[:, None]
        p[:, column] = q[:, 0]
    return LanguageModel(langs, pieces, p, np.log(np.array([prior[x] for x in langs], np.float64)) if langs else np.zeros(0))


def fit_languages(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, lang_col: str, max_docs: int = MAX_DOCS) -> LanguageModel:
    """A model learnt from the texts and non-null languages of ``docs``."""
    docs = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    n = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    pieces = vocabulary(tokenizer)
    if not n:
        return train({}, pieces, {})
    limits = F.create_map(*[F.lit(x) for lang, k in n.items() for x in (lang, hash_limit(k, max_docs))])
    sample = docs.filter(F.xxhash64("id") <= limits[F.col("lang")])
    counts = sample.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words: dict[str, dict[str, int]] = {}
    for r in counts.orderBy("lang", "word").collect():
        words.setdefault(r["lang"], {})[r["word"]] = r["n"]
    words = {k: v for k, v in words.items() if v}
    return train(words, pieces, {k: float(n[k]) for k in words})


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    counts: dict[str, Counter] = {}

    def rows() -> pa.RecordBatch:
        flat = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        cols = list(zip(*flat)) if flat else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts.setdefault(lang, Counter()).update(letter_words(text.as_py()))
        if sum(map(len, counts.values())) > 300_000:
            yield rows()
    yield rows()


class _Numbers(dict):
    """Word -> row of the score matrix; words not met before get the next rows."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


#: What a worker holds of the last model: its name, the words' rows and their scores.
_held: list = [None, None, None]


def _predict(model, name: str = "", limit: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = model.value
        if _held[0] != name or not name:
            _held[:] = [name, _Numbers(), np.zeros((0, len(m.langs)))]
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                if len(_held[1]) > limit:
                    _held[1:] = [_Numbers(), np.zeros((0, len(m.langs)))]
                numbers, scores = _held[1:]
                docs = []
                for x in batch.column(1):
                    words = letter_words(x.as_py())
                    docs.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                if len(numbers) > len(scores) and m.langs:
                    fresh = list(numbers)[len(scores) :]
                    scores = _held[2] = np.vstack([scores, m.word_scores(fresh)])
                langs, values = [], []
                for ids in docs:
                    if not len(ids) or not m.langs:
                        langs.append("und")
                        values.append(0.0)
                        continue
                    s = scores[ids].sum(axis=0) + m.prior
                    s = np.exp(s - s.max())
                    best = int(s.argmax())
                    langs.append(m.langs[best])
                    values.append(float(min(1.0, s[best] / s.sum())))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(values, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    return run


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def predict_languages(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: LanguageModel | None = None) -> DataFrame:
    """A row for each row: id, ``held_out``, ``lang_pred`` and ``score``, the posterior of that language.

    Learns from rows that aren't held out (crc32 of the id as text, mod 4, is 2) unless a model is given; predicts from the
    whole text alone. A text that is null or has no letter, and any text when no row can be learnt from, is ``und`` with
    score 0. A letter is one by Unicode, so numerals alone are ``und``. Texts and words of any length are scored whole. A null id
    isn't held out. Ties go to the first language by name. Rows that repeat are rows of their own; extra columns are ignored,
    whatever their names; an empty table gives an empty one.
    """
    if model is None:
        model = fit_languages(docs.filter(~held_out(F.col(id_col))), tokenizer, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_predict(shared, uuid.uuid4().hex), f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
