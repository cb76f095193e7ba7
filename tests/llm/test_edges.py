"""Streams with tags anywhere, letters and numerals, the field against all labellings, weak labels against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest

from pointloom.llm import langid, mpeg, pii, quality
from pointloom.llm.sampling import hash_limit

WORDS = (b"TAG", b"APETAGEX", b"ID3", b"Xing", b"VBRI", mpeg._HEAD, b"\xff\xfb\x90\x00")


@pytest.mark.parametrize("word", WORDS)
def test_payload_with_marks_at_every_place(word):
    for at in range(mpeg.UNIT):
        unit = (b"x" * at + word + b"y" * mpeg.UNIT)[: mpeg.UNIT]
        for payload in (unit, b"q" * mpeg.UNIT + unit):
            assert mpeg.read_payload(mpeg.write(payload)) == payload


def test_tags_at_the_end():
    stream, v1 = mpeg.write(b"a" * 1152), b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
    ape = b"0123456789" + b"APETAGEX" + (2000).to_bytes(4, "little") + (42).to_bytes(4, "little") + bytes(16)
    for tail, n, title in ((b"", 0, None), (v1, 128, "Title"), (ape, 42, None), (ape + v1, 170, "Title")):
        s = mpeg.parse(stream + tail)
        assert (len(s.offsets), s.tail, s.skipped, s.tags.get("title")) == (2, n, 0, title)
    s = mpeg.parse(stream + b"between" + v1)
    assert (len(s.offsets), s.tail, s.skipped, s.resyncs) == (2, 128, 7, 1)
    assert mpeg.parse(v1).tail == 128 and not mpeg.parse(v1).offsets


def test_layers_versions_and_tables():
    def head(version, layer, index, rate, mode=0, protected=False):
        return (0x7FF << 21 | {1: 3, 2: 2, 2.5: 0}[version] << 19 | (4 - layer) << 17 | (not protected) << 16 | index << 12 | rate << 10 | mode << 6).to_bytes(4, "big")

    for version, layer, samples, hz in ((1, 1, 384, 44100), (1, 2, 1152, 44100), (1, 3, 1152, 44100), (2, 3, 576, 22050), (2.5, 3, 576, 11025), (2, 2, 1152, 22050)):
        own = head(version, layer, 5, 0)
        h = mpeg._header(int.from_bytes(own, "big"))
        assert (h.samples, h.rate) == (samples, hz)
        s = mpeg.parse(b"junk" + (own + bytes(h.size - 4)) * 5)
        assert len(s.offsets) == 5 and s.skipped == 4 and s.duration == mpeg.Fraction(5 * samples, hz)
    own = head(1, 1, 5, 0, mode=1, protected=True)
    h = mpeg._header(int.from_bytes(own, "big"))
    bits = bytes(range(18))
    assert mpeg._allocation(own[3], h) == 18
    good = own + mpeg.crc16(own[2:] + bits).to_bytes(2, "big") + bits
    frames = good.ljust(h.size, b"\0") + (good[:10] + b"!" + good[11:]).ljust(h.size, b"\0")
    s = mpeg.parse(frames)
    assert (s.protected, s.bad_crc) == (2, 1)
    own = head(1, 3, 9, 0)
    vbri = own + bytes(32) + b"VBRI" + mpeg.struct.pack(">HHHIIHHHH", 1, 0, 75, 1000, 3, 2, 2, 2, 1) + b"\0\1\0\2"
    h = mpeg._header(int.from_bytes(own, "big"))
    s = mpeg.parse(vbri.ljust(h.size, b"\0") + (own + bytes(h.size - 4)) * 3)
    assert s.table["kind"] == "VBRI" and s.table["frames"] == 3 and s.table["steps"] == [2, 4] and len(s.offsets) == 3
    text = b"\3Ti\xc3\xa9"
    tag = b"TIT2" + bytes([0, 0, 0, len(text)]) + b"\0\0" + text
    s = mpeg.parse(b"ID3\4\0\0" + bytes([0, 0, 0, len(tag)]) + tag + own + bytes(h.size - 4))
    assert s.tags == {"TIT2": "Tié"} and len(s.offsets) == 1


def test_media_that_are_none(spark):
    df = spark.createDataFrame([(1, 3, None), (2, 4, bytearray()), (None, 0, bytearray(b"no audio"))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in mpeg.media_digests(df).collect()}
    assert got[1].payload_sha256 is None and got[1].media_bytes is None and got[2].payload_bytes == 0 and got[None].media_bytes == 8


def test_letters():
    for text in ("²", "½ ½", "Ⅷ", "١٢", "①", "12_3", "  ", "!", None):
        assert langid.letter_words(text) == []
    assert langid.letter_words("Ab1ß²CD 日本 x_y") == ["ab", "ß", "cd", "日本", "x", "y"]
    assert [len(w) for w in langid.letter_words("a" * 60)] == [24, 24, 12]


def test_numerals_are_no_language(spark):
    model = langid.train({"de": {"das": 3, "ist": 2}, "en": {"the": 3, "is": 2}}, {"▁": 1, "▁the": 2, "das": 3, "is": 4}, {"de": 1.0, "en": 1.0})
    rows = [(1, "² ½", None), (2, "the ²", None), (3, "das " * 5000, None), (4, "das", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_languages(df, "", model=model).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] == "en" and got[3][0] == got[4][0] == "de"


def test_a_share_of_any_number_of_rows():
    assert hash_limit(10, 10) == hash_limit(3, 10) == (1 << 63) - 1
    for rows in (11, 10**6, 10**10, 10**13):
        share = (hash_limit(rows, 10) + (1 << 63)) / (1 << 64)
        assert share * rows == pytest.approx(10, rel=1e-4) and share > 0


def labellings(spans, n, at=0):
    """All ways to lay spans (pairs of boundary numbers) of any kind from boundary ``at`` on."""
    if at == n - 1:
        yield ()
        return
    yield from labellings(spans, n, at + 1)
    for i, (a, b) in enumerate(spans):
        if a == at:
            for rest in labellings(spans, n, b):
                for kind in range(len(pii.KINDS)):
                    yield ((i, kind), *rest)


def test_decoding_and_sums_against_all_labellings():
    rng = np.random.default_rng(3)
    for text in ("a1@b", "+1 2", "x=9f", "1.2.3"):
        for _ in range(4):
            field = pii.SemiMarkov(rng.standard_normal((len(pii.NAMES), len(pii.KINDS))))
            bounds, spans, x = field.candidates(text, 0, len(text))
            scores = x @ field.weights
            every = list(labellings(spans, len(bounds)))
            sums = [sum(scores[i, k] for i, k in found) for found in every]
            best = every[int(np.argmax(sums))]
            assert field.decode(text, 0, len(text)) == [(bounds[spans[i][0]], bounds[spans[i][1]], pii.KINDS[k]) for i, k in best]
            total, want = math.fsum(math.exp(s) for s in sums), np.zeros_like(scores)
            for found, s in zip(every, sums):
                for i, k in found:
                    want[i, k] += math.exp(s) / total
            assert np.allclose(field._expected(len(bounds), spans, scores), want)


def test_dense_texts_in_pieces(monkeypatch):
    """A long text of short tokens with digits: the same spans in steps of any length, none over a base span."""
    rng = random.Random(1)
    text = " ".join(rng.choice(["10.0.0.%d" % rng.randrange(300), "a%d@b.cd" % rng.randrange(99), "id=%x" % rng.randrange(1 << 60), "%d" % rng.randrange(10**9), "+1 202 555 01%02d" % rng.randrange(99)]) for _ in range(1500))
    field = pii.SemiMarkov(np.random.default_rng(2).standard_normal((len(pii.NAMES), len(pii.KINDS))))
    base, spans = pii.all_spans(text, field)
    for step, held in ((7, 10), (100_000, 10)):
        monkeypatch.setattr(pii, "STEP", step)
        monkeypatch.setattr(pii, "HELD", held)
        assert pii.all_spans(text, pii.SemiMarkov(field.weights)) == (base, spans)
    assert len(base) > 500 and set(base) <= set(spans) and len(spans) > len(base) + 100
    own = set(base)
    assert not any(a < y and x < b for a, b, _ in (s for s in spans if s not in own) for x, y, _ in base)


def test_parts_of_regions():
    assert list(pii._parts("a1 b2  c3", 5)) == ["a1 b2", "c3"]
    assert list(pii._parts("a1 " + "9" * 20 + " c3", 5)) == ["a1", "c3"]
    assert list(pii._parts("9" * 20, 5)) == [] and list(pii._parts("  ", 5)) == []


def test_whole_words_have_shapes():
    shapes = quality._Shapes()
    assert shapes[b"ab" * 40] != shapes[b"ab" * 40 + b"#"] and shapes[b"a" * 5000] == shapes[b"a" * 3]
    assert all(len(w) <= 64 for w in shapes)


def test_weak_labels_against_plain_loops():
    """The same maximisation, a document at a time."""
    rng = random.Random(4)
    docs = []
    for _ in range(300):
        good = rng.random() < 0.7
        docs.append(tuple(0 if rng.random() < 0.3 else (1 if rng.random() < (0.9 if good else 0.2) else -1) for _ in range(4)))
    kinds = sorted(set(docs))
    model = quality.fit_weak_labels(np.array(kinds), np.array([docs.count(k) for k in kinds], float), rounds=7)
    post = [0.1 if -1 in v else 0.95 for v in docs]
    for _ in range(7):
        good, bad = [], []
        for i in range(4):
            for out, part, ups, alls in ((good, post, 1.8, 2), (bad, [1 - p for p in post], 1, 2)):
                up = sum(p for p, v in zip(part, docs) if v[i] > 0) + ups
                out.append(up / (sum(p for p, v in zip(part, docs) if v[i]) + alls))
        share = (sum(post) + 1) / (len(docs) + 2)
        good, bad = [min(max(max(g, b), 0.01), 0.999) for g, b in zip(good, bad)], [min(max(min(g, b), 0.001), 0.99) for g, b in zip(good, bad)]
        post = []
        for v in docs:
            g, b = share, 1 - share
            for i, x in enumerate(v):
                g *= good[i] if x > 0 else 1 - good[i] if x < 0 else 1
                b *= bad[i] if x > 0 else 1 - bad[i] if x < 0 else 1
            post.append(g / (g + b))
    assert np.allclose(model.good, good) and np.allclose(model.bad, bad) and model.share == pytest.approx(share)
    assert np.allclose(model.posterior(np.array(docs)), post)
