"""BPE encoding and decoding with content-defined chunks that documents share.

A text is cut after white space where a rolling hash of the WINDOW words before says so, so that a passage gives the same
chunks wherever it stands. A chunk that was met before is not encoded again, and neither is a word of a new chunk: a worker
holds up to CACHE_CHARS characters of chunks and CACHE_WORD_CHARS of words.

A join of chunks is exact if the encoding of both sides together is that of each alone. That is tested on the words next to
the join: they are encoded together and must give the same ids as apart. If not, more words on either side join the test, in
doubling numbers, until it agrees; what was tested then replaces the ids of the words it covers. If both chunks are used up,
the whole text is encoded. Tests are remembered by the characters beside the join. Words of one chunk all end in ASCII white
space, and are encoded one by one only if the tokenizer showed at the start that such joins hold for all kinds of neighbours.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches
from .worker import held

WINDOW = 4
MASK = 31
CACHE_CHARS = 4_000_000
CACHE_WORD_CHARS = 5_000_000
_WORD = re.compile(r"[^ \t-\r]+[ \t-\r]*|[ \t-\r]+")


def chunks(text: str, window: int = WINDOW, mask: int = MASK) -> list[list[str]]:
    """The text as lists of words (each with the white space after it); about ``mask`` + 1 words each, cut by content alone."""
    words = _WORD.findall(text)
    n = len(words)
    if n <= window:
        return [words] if words else []
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    rolled = ids[: n - window + 1].copy()
    for i in range(1, window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + ids[i : n - window + 1 + i]
    rolled ^= rolled >> np.uint64(29)
    cuts = (np.flatnonzero((rolled & np.uint64(mask)) == 0) + window).tolist()
    bounds = [0, *(c for c in cuts if c < n), n]
    return [words[a:b] for a, b in zip(bounds, bounds[1:]) if b > a]


class ChunkEncoder:
    """Encodes texts exactly as the tokenizer does, chunk by chunk."""

    def __init__(self, path: str, cache_chars: int = CACHE_CHARS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, list[int]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        # one object for each number: what is held stays small
        self.numbers = list(range(self.tokenizer.get_vocab_size(with_added_tokens=True)))
        self.held_words = 0
        self.joins: dict[tuple[str, str], bool] = {}
        self.held, self.limit = 0, cache_chars
        self.reused = self.encoded = self.repaired = 0
        self.plain = self._plain()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self) -> bool:
        """Whether joins after each ASCII white space hold between all of a table of neighbours."""
        edges = [chr(c) for c in range(33, 127)] + list("éñßİΣ日한\u0301\u1161\u200b\x1c\x85\xa0")
        whole, parts = [], []
        for gap in " \t\n\r\x0b\x0c":
            left, right = (edges, edges) if gap == " " else (edges[::7], edges[::5])
            whole += [a + gap + b for a in left for b in right]
            parts += [(a + gap, b) for a in left for b in right]
        words = list({w for p in parts for w in p})
        alone = dict(zip(words, self._ids(words)))
        return all(alone[a] + alone[b] == ids for (a, b), ids in zip(parts, self._ids(whole)))

    def _chunk_ids(self, fresh: dict[str, list[str]]) -> list[list[int]]:
        """Ids of chunks that weren't met before."""
        if not self.plain:
            return self._ids(list(fresh))
        known = self.words
        missing = list({w for words in fresh.values() for w in words if w not in known})
        size = sum(map(len, missing))
        if self.held_words + size > CACHE_WORD_CHARS:
            known.clear()
            missing = list({w for words in fresh.values() for w in words})
            self.held_words, size = 0, sum(map(len, missing))
        self.held_words += size
        if missing:
            one = self.numbers.__getitem__
            known.update((w, tuple(map(one, ids))) for w, ids in zip(missing, self._ids(missing)))
        out = []
        for words in fresh.values():
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; a null text counts as empty."""
        split = [[(c, "".join(c)) for c in chunks(t)] if t else [] for t in texts]
        fresh = {s: c for doc in split for c, s in doc if s not in self.cache}
        self.reused += sum(map(len, split)) - len(fresh)
        self.encoded += len(fresh)
        now = dict(zip(fresh, self._chunk_ids(fresh))) if fresh else {}
        out = []
        self._test([(a[-1], b[0]) for doc in split for (a, _), (b, _) in zip(doc, doc[1:])])
        for text, doc in zip(texts, split):
            ids: list[int] | None = []
            before: list[str] = []
            for words, s in doc:
                own = now[s] if s in now else self.cache[s]
                if before and not self.joins[self._edge(before[-1], words[0])]:
                    ids = self._repair(ids, before, own, words)
                    if ids is None:
                        ids = self._ids([text])[0]
                        break
                else:
                    ids += own
                before = words
            out.append(ids)
        for s in fresh:
            if self.held + len(s) > self.limit:
                self.cache.clear()
                self.held = 0
            self.cache[s] = now[s]
            self.held += len(s)
        return out

    @staticmethod
    def _edge(a: str, b: str) -> tuple[str, str]:
        """What stands beside a join: all of both words, if any character next to it isn't ASCII."""
        left, right = a[-3:], b[:2]
        return (left, right) if left.isascii() and right.isascii() and left[-1] in " \t\n\r\x0b\x0c" else (a, b)

    def _test(self, pairs: list[tuple[str, str]]) -> None:
        """Whether the words on both sides of a join encode together as they do apart."""
        if len(self.joins) > 200_000:
            self.joins.clear()
        fresh = {e: p for p in pairs if (e := self._edge(*p)) not in self.joins}
        if not fresh:
            return
        ids = self._ids([x for a, b in fresh.values() for x in (a, b, a + b)])
        for k, e in enumerate(fresh):
            self.joins[e] = ids[3 * k] + ids[3 * k + 1] == ids[3 * k + 2]

    def _repair(self, ids: list[int], before: list[str], own: list[int], words: list[str]) -> list[int] | None:
        """The ids up to the end of ``words``, from encoding more and more words around the join; None if none agree."""
        self.repaired += 1
        k = 1
        while k < len(before) or k < len(words):
            left, right = before[-k:], words[:k]
            k *= 2
            wide_l, wide_r = before[-k:], words[:k]
            parts = ["".join(wide_l[: len(wide_l) - len(left)]), "".join(left + right), "".join(wide_r[len(right) :]), "".join(wide_l + wide_r), "".join(wide_l), "".join(wide_r)]
            more_l, small, more_r, whole, l_own, r_own = self._ids(parts)
            if more_l + small + more_r == whole and ids[len(ids) - len(l_own) :] == l_own and own[: len(r_own)] == r_own:
                return [*ids[: len(ids) - len(l_own)], *whole, *own[len(r_own) :]]
        return None


def _encoder(path: str) -> ChunkEncoder:
    """One encoder, with what it holds, for all tasks of a worker, until it has tasks of another kind."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("bpe", path), lambda: ChunkEncoder(path))


def decoder(tokenizer):
    """The library's decode(ids, skip_special_tokens=False); without a decoder that is the tokens, joined by spaces."""
    if tokenizer.decoder is not None:
        return lambda ids: tokenizer.decode(ids, skip_special_tokens=False)
    table = {i: s for s, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    return lambda ids: " ".join([table[i] for i in ids])


def _run(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        decimal = [str(i) for i in range(encoder.tokenizer.get_vocab_size(with_added_tokens=True))]
        decode = decoder(encoder.tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                ids = encoder.encode_batch(batch.column(1).to_pylist())
                cols = [batch.column(0), pa.array([len(x) for x in ids], pa.int64())]
                if keep_ids:
                    cols += [pa.array(ids, pa.list_(pa.int32())), pa.array([decode(x) for x in ids], pa.string())]
                    names = ["id", "n_tokens", "ids", "decoded"]
                else:
                    sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                    cols += [pa.array([sha(" ".join([decimal[i] for i in x])) for x in ids], pa.string()), pa.array([sha(decode(x)) for x in ids], pa.string())]
                    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """A row for each row: id, ``n_tokens`` and ``ids``, ``decoded``, or with ``keep_ids`` false their SHA-256 digests.

    ``tokenizer`` is the path of a tokenizers JSON file that every executor can open. Special tokens in a text are encoded
    as the library does; none are added. Null and empty texts have no tokens. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    more = "ids array<int>, decoded string" if keep_ids else "ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(_run(tokenizer, keep_ids), f"id {kind}, n_tokens long, {more}").withColumnRenamed("id", id_col)
