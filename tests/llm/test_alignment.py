"""Cross-tokenizer alignment against the two tokenizers on whole texts."""

import bisect
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from plumbline.llm import alignment, queries
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    None, "", " ", "  ", "a  b", " a", "a ", "x\n\n y", "it's  don't", "a \nb", "\n a  ", "<|endoftext|> x <s> y </s>", "<0x0A> <unk>", "▁ a▁b", "é  ç k", "é ﬁ ª µ",
    "漢字 🙂 漢字", "a\x1c b \x1c", "a\tb", "a\xa0b  c", "tokenization of unbelievably long-winded words", "the cat the cat the cat", "the cat", "x" * 300, "\0a b",
]


@pytest.fixture(scope="module")
def plain():
    """Tokens, groups and links of a whole text, without cutting it; None if it has no tokens."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of = alignment.byte_level()

    def of_text(text):
        if not text:
            return None
        x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        raw = [[bytes(of[c] for c in t) for t in x.tokens], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]]
        if any(b"".join(r) != f" {text}".encode() for r in raw):
            return None
        ends = [[0], [0]]
        for e, r in zip(ends, raw):
            for t in r:
                e.append(e[-1] + len(t))
        links = [(x.ids[i], y[j]) for i in range(len(x.ids)) for j in range(max(0, bisect.bisect_right(ends[1], ends[0][i]) - 1), len(y)) if ends[1][j] < ends[0][i + 1] and ends[0][i] < ends[1][j + 1]] if len(x.ids) < 500 else None
        cuts = sorted(set(ends[0]) & set(ends[1]))
        part = lambda ids, e, u, v: ",".join(str(ids[k]) for k in range(bisect.bisect_left(e, u), bisect.bisect_left(e, v)))
        groups = [f"{part(x.ids, ends[0], u, v)}|{part(y, ends[1], u, v)}" for u, v in zip(cuts, cuts[1:])]
        return len(x.ids), len(y), groups, links

    return of_text


def expected(rows, plain):
    found = [(i, plain(t)) for i, t in rows]
    counts = Counter(p for _, f in found if f for p in set(f[3]))
    top = Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    none = (0,) * 6 + ("",)
    return sorted((i, *(none if not f else (f[0], f[1], len(f[2]), len(f[3]), sum(counts[p] == top[p[0]] for p in f[3]), sum(counts[p] for p in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()))) for i, f in found)


def aligned(docs, **how):
    return sorted(tuple(r) for r in alignment.align(docs, A, B, **how).select(*COLUMNS).collect())


def odd_rows():
    r = random.Random(5)
    texts = TEXTS + ["".join(r.choice("ab éà1.,'|\n ▁  漢") for _ in range(r.randint(1, 60))) for _ in range(120)] + ["the cat"] * 3
    return list(enumerate(texts))


@pytest.mark.parametrize("copies", [False, True])
def test_equals_whole_texts(documents, plain, copies):
    rows = odd_rows()
    docs = documents([(i, t, "s") for i, t in rows], extra=True).repartition(3)
    assert aligned(docs, copies=copies) == expected(rows, plain)


def test_a_table_of_words_that_is_forgotten_again_and_again(plain):
    rows = odd_rows()
    al = alignment.Aligner(A, B, known=10)
    for _ in range(2):
        for at in range(0, len(rows), 5):
            some = [t or "" for _, t in rows[at : at + 5]]
            ((_, s),) = al.slices(alignment.pa.array(some))
            want = [plain(t) for t in some]
            assert s.valid.tolist() == [w is not None for w in want]
            assert s.totals()[3].tolist() == [len(w[3]) if w else 0 for w in want]
            keys, times, sizes = (x.tolist() for x in s.pairs())
            held = [Counter(a << alignment.SHIFT | b for a, b in w[3]) if w else {} for w in want]
            assert sizes == [len(h) for h in held] and list(zip(keys, times)) == [x for h in held for x in sorted(h.items())]
    keys = alignment.np.array([3, 1, 3, 2, 1])
    assert [x.tolist() for x in alignment.merged(keys, keys)] == [[1, 2, 3], [2, 2, 6]]


def test_runs_of_a_key_go_over_batches_and_shards(monkeypatch):
    monkeypatch.setattr(alignment, "SHARD", 3)
    rows = sorted([(k << alignment.SHIFT | k % 3, 1) for k in range(10) for _ in range(k + 1)])
    batches = [alignment.pa.RecordBatch.from_pydict({"key": [k for k, _ in rows[i : i + 4]], "n": [n for _, n in rows[i : i + 4]]}) for i in range(0, len(rows), 4)]
    found = {}
    for b in alignment._shards(iter(batches)):
        for data in b.column("data"):
            keys, n = alignment.np.frombuffer(data.as_py(), dtype="<i8").reshape(2, -1)
            assert len(keys) <= 3 and not found.keys() & set(keys.tolist())
            found |= dict(zip(keys.tolist(), n.tolist()))
    assert found == Counter(k for k, _ in rows)


def test_packed_pairs_round_trip():
    r = alignment.np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = alignment.np.unique(r.integers(0, 1 << alignment.KEY_BITS, n))
        times = r.integers(1, 1 << 31, len(keys))
        back = alignment.unpacked(alignment.packed(keys, times), len(keys))
        assert [x.tolist() for x in back] == [keys.tolist(), times.tolist()]


def test_links(documents, plain):
    rows = odd_rows()
    found = {(r["a"], r["b"]): r["n"] for r in alignment.links(documents([(i, t, "s") for i, t in rows]), A, B).collect()}
    assert found == Counter(p for _, t in rows for p in set((plain(t) or (0, 0, 0, []))[3]))


def test_long_text_repeated_rows_and_empty_table(documents):
    long = "the cat sat on the mat. " * 60_000
    rows = aligned(documents([(1, long, "s"), (2, "the cat", "s"), (2, "the cat", "s"), (None, "the cat", "s")]).repartition(2).fillna({"doc_id": -1}))
    assert [r[0] for r in rows] == [-1, 1, 2, 2]
    assert rows[0][1:] == rows[2][1:] == rows[3][1:] and rows[1][1] > 400_000
    assert aligned(documents([])) == []
    assert {r[1:] for r in aligned(documents([(1, None, "s"), (2, "", "s")]))} == {(0,) * 6 + ("",)}


def test_query(spark, documents, plain, tmp_path):
    rows = odd_rows()
    documents([(i, t, "s") for i, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in queries.op12_token_alignment(spark, str(tmp_path)).select(*COLUMNS).collect()) == expected(rows, plain)
