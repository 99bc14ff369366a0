"""Token ids, packing and token files, by exact round trips."""

import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from plumbline.llm import packing, pfor
from plumbline.llm.tokens import Encoder
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "  ", "a  b", " a", "a ", "x\n\n y", "it's  don't", "a \nb", "\n a  ", "é  ç <|endoftext|> k", "漢字 🙂", "a ,b c5d 5 $x= .\nA", '.. a1b2 "q" (x)\n', "a\x1c b \x1c", "Le réouant, aux éoleré.", "ª µ º x"]


@pytest.fixture(scope="module")
def want():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def test_ids(want):
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("ab éà1.,'|\n  ") for _ in range(r.randint(1, 40))) for _ in range(300)]
    encoder = Encoder(PATH)
    for _ in range(2):  # the second time from the caches
        assert encoder.ids_of(texts) == [want(t).tobytes() for t in texts]


def test_files():
    r = np.random.default_rng(2)
    for m in (0, 1, 127, 128, 129, 5000):
        ids = r.integers(0, 50_000, m).astype("<u4")
        ids[::37] = 1 << 30
        ids[1::2] %= 100
        file = pfor.TokenFile(pfor.encode_file([m], ids))
        assert (file.ids() == ids).all()
        for a, b in ((0, m // 2), (m // 3, m), (m // 2, m // 2)):
            assert (file.ids(a, b) == ids[a:b]).all()


def test_written_and_read(spark, documents, odd, want, monkeypatch):
    df = documents(odd, extra=True)
    got = pfor.read_ids(spark, pfor.write_ids(df, PATH)).orderBy("start").collect()
    texts = sorted(((i is not None, i or 0, t or ""), t) for i, t, _ in odd)
    at = 0
    for r, (key, text) in zip(got, texts, strict=True):
        ids = want(text)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (key[1] if key[0] else None, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert pfor.read_ids(spark, pfor.write_ids(df.limit(0), PATH)).count() == 0


def check_packed(rows, length, ids_of):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for spans in by_sequence.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= length
    return by_doc, len(by_sequence)


def test_packing(spark, documents, want):
    r = random.Random(3)
    data = [(i, " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(r.choice([0, 1, 3, 10, 25, 60, 200]))), "s") for i in range(200)]
    rows = packing.pack(packing.pieces(documents(data), PATH, 64), 64).collect()
    by_doc, n = check_packed(rows, 64, want)
    for i, text, _ in data:
        ids, at = want(text), 0
        for k, p in enumerate(sorted(by_doc[i], key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (k, at) and (k == 0 or p["length"] == 64)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    total = sum(len(want(t)) for _, t, _ in data)
    assert n <= -(-total // 64) * 1.02 + 1


def test_packing_odd(spark, documents, odd, want):
    df = documents(odd, extra=True)
    rows = packing.pack(packing.pieces(df, PATH)).collect()
    check_packed(rows, packing.LENGTH, want)
    assert sum(r["length"] for r in rows) == sum(len(want(t)) for _, t, _ in odd)
    assert packing.pack(packing.pieces(df.limit(0), PATH)).count() == 0


def plain_best_fit(sizes, length):
    """The number of sequences of best-fit decreasing, one piece at a time."""
    gaps, n = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, size)
        if at < len(gaps):
            room = gaps.pop(at)
        else:
            room, n = length, n + 1
        bisect.insort(gaps, room - size)
    return n


@pytest.mark.parametrize("most, n", [(6, 2000), (64, 1500), (40, 700), (25, 1), (33, 65)])
def test_supersteps_fill_as_best_fit_does(spark, monkeypatch, most, n):
    monkeypatch.setattr(packing, "SWEEP_ROWS", 100)  # several partitions
    r = random.Random(most)
    sizes = [r.randint(1, most) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long").repartition(3)
    rows = packing.pack(df, 64).collect()
    assert sorted((x["doc_id"], x["length"]) for x in rows) == list(enumerate(sizes))
    _, used = check_packed(rows, 64, None)
    assert used <= plain_best_fit(sizes, 64) * 1.01 + 1


def test_one_superstep_is_the_plain_sweep(spark, monkeypatch):
    monkeypatch.setattr(packing, "SWEEP_ROWS", 20)
    r = random.Random(12)
    for _ in range(4):
        pieces = [(i, r.randint(20, 60)) for i in range(r.randint(1, 80))]
        gaps = [(i, r.randint(10, 62)) for i in range(r.randint(1, 80))]
        sizes = [s for _, s in pieces]
        now = {"n": len(sizes), "most": max(sizes), "least": min(sizes)}
        left, open_ = spark.createDataFrame(pieces, "id long, size long"), spark.createDataFrame(gaps, "seq long, room long")
        found, rest = packing._superstep(left, open_, now, len(gaps))
        rooms, want, lost = sorted(room for _, room in gaps if room >= min(sizes)), [], []
        for size in sorted(sizes, reverse=True):  # each takes the smallest gap that still holds it
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                want.append((size, rooms.pop(at)))
            else:
                lost.append(size)
        got = found.collect()
        assert sorted((x["size"], x["room"]) for x in got) == sorted(want) and sorted(x["size"] for x in rest.collect()) == sorted(lost)
        assert len({x["seq"] for x in got}) == len(got)
