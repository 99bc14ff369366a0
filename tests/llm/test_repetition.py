"""Repetition measures against brute force."""

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import repetition


def slow(words):
    n = len(words)
    windows = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = {j for i in range(n - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    longest = next(k for k in range(n, -1, -1) if k == 0 or max(Counter(tuple(words[i : i + k]) for i in range(n - k + 1)).values()) > 1)
    return len(covered), longest if longest >= 5 else 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repeats_equal_brute_force(words):
    got = repetition.measure(" ".join(words))
    assert (got[4], got[5]) == slow(words)


def brute(words):
    """Covered words, their spans and the verdict, from all pairs of positions."""
    n = len(words)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)
    covered = [any(best[j] >= 10 and j <= i < j + best[j] for j in range(n)) for i in range(n)]
    edges = [i for i in range(n + 1) if (i < n and covered[i]) != (i > 0 and covered[i - 1])]
    spans = ",".join(f"{a}:{b}" for a, b in zip(edges[::2], edges[1::2]))
    repeated = slow(words)[0]
    longest = max(best, default=0)
    failed = n < 10 or 100 * repeated > 20 * n
    return sum(covered), spans, failed, not (failed or sum(covered) > n / 10 or longest >= 30 and longest > n / 20)


def test_verdicts_equal_brute_force():
    r = random.Random(6)
    verdicts = Counter()
    for _ in range(150):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randint(0, 160))]
        for _ in range(r.randint(0, 2)):
            if words:
                at, size = r.randrange(len(words)), r.randint(3, 45)
                words[(to := r.randrange(len(words))) : to] = words[at : at + size]
        got = repetition.measure(" ".join(words))
        want = brute(words)
        assert (got[6], got[9], got[7], got[8]) == want
        verdicts[got[7:9]] += 1
    assert len(verdicts) == 3  # failed by the base, by the method alone, and kept


def test_long_text_with_long_repeats():
    import tracemalloc

    words = " ".join(f"w{i}" for i in range(100_000))
    tracemalloc.start()
    got = repetition.measure(f"{words} x {words}")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[5] == 100_000 and got[6] == 200_000 and peak < 60e6


def test_suffix_array():
    r = random.Random(4)
    for n in (1, 2, 7, 200):
        ids = np.array([r.randrange(3) for _ in range(n)])
        order = repetition.suffix_array(ids)
        assert sorted(range(n), key=lambda i: list(ids[i:])) == list(order)


def test_counts_and_verdicts():
    text = "One two*  three\nfour five\n\nfour five\n six sé#ven"
    assert repetition.measure(text)[:4] == (9, 37, 2, 1)
    clean = " ".join(f"w{i}" for i in range(400))
    refrain = " ".join(f"r{i}" for i in range(12))
    assert repetition.measure(clean)[8] and repetition.measure(f"{refrain} {clean} {refrain}")[8]
    long = " ".join(f"r{i}" for i in range(60))
    assert not repetition.measure(f"{long} {clean} {long}")[8]
    assert not repetition.measure("only three words")[8] and not repetition.measure("a b " * 50)[8]


def test_method_rejects_what_the_base_keeps():
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    long, rest = words("r", 150), words("w", 850)
    found = repetition.measure(f"{long} {rest} {long} {words('v', 850)}")
    assert found[0] == 2000 and not found[7] and not found[8]
    passages = [words(f"p{k}x", 25) for k in range(3)]
    found = repetition.measure(" ".join([*passages, words("w", 850), *passages[::-1]]))
    assert found[5] == 25 and found[6] == 150 and not found[7] and not found[8]
    refrain = words("r", 12)
    found = repetition.measure(" ".join(x for k in range(4) for x in (refrain, words(f"v{k}x", 150))))
    assert not found[7] and found[8]
    found = repetition.measure(f"{words('r', 40)} {words('w', 1500)} {words('r', 40)}")
    assert not found[7] and found[8]


def test_documents(spark, documents, odd):
    df = documents(odd)
    found = repetition.quality(df.select("doc_id", "text"))
    assert found.count() == len(odd)
    named = repetition.quality(documents(odd, extra=True))
    assert [c for c in named.columns if c in ("kept", "n_words", "spans")] == ["n_words", "kept", "spans"]
    assert named.where("kept = true").count() == 3
    clash = documents(odd, extra=True)
    kept = repetition.accepted(clash)
    assert kept.columns == clash.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "5", "None"]
    assert repetition.accepted(clash.limit(0)).count() == 0
