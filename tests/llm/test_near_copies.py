"""Near copies of five-word shingles against brute force, and the pipeline's stage."""

import random

import numpy as np
import pytest
from plumbline.llm import near_copies, simhash
from pyspark.sql import functions as F


def brute(text):
    words = (text or "").lower().split(" ")
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words != [""] else set()


def groups(texts):
    sets, label = {i: brute(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and (sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    return label


def corpus():
    """Originals, copies at similarities about 0.8, chains of copies of copies, and one large group."""
    r = random.Random(7)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]

    def edited(text, n):
        text = list(text)
        for at in r.sample(range(len(text)), n):
            text[at] = f"x{r.randrange(10**6)}"
        return text

    texts = []
    for _ in range(40):
        base = words(200)
        texts += [base, edited(base, 3), edited(base, 12)]
    hot = words(120)
    texts += [edited(hot, r.randrange(3)) for _ in range(60)]
    alike = words(100)  # a family below 0.8, but for some of its members
    family = [edited(alike, r.randrange(3, 9)) for _ in range(50)]
    texts += family + [edited(t, 1) for t in family[:6]]
    texts += [[], [], ["one"], ["two", "words"]]
    return {i: " ".join(t) for i, t in enumerate(texts)}


def test_shingles_and_similarity():
    a, b = "a b c d e f", "A b c d e F"
    assert len(near_copies.shingles(a)) == 2 and list(near_copies.shingles(a)) == list(near_copies.shingles(b))
    assert near_copies.jaccard(near_copies.shingles(a), near_copies.shingles("a b c d e g")) == pytest.approx(1 / 3)
    assert near_copies.jaccard(near_copies.shingles(""), near_copies.shingles(" ")) == 1


def test_exact_links(monkeypatch):
    monkeypatch.setattr(near_copies, "COLUMNS", 16)
    r = np.random.default_rng(4)
    for _ in range(20):
        base = r.integers(0, 1000, 60)
        sets = [np.unique(np.concatenate([base[: r.integers(30, 61)], r.integers(0, 1000, r.integers(0, 12))])).astype(np.uint64) for _ in range(25)]
        own = r.integers(0, 20, 25)
        links = near_copies.exact_links(sets, own)
        assert all(own[i] != own[j] and near_copies.jaccard(sets[i], sets[j]) >= 0.8 for i, j in links)

        def joined(pairs):
            label = {int(g): int(g) for g in own}
            for i, j in pairs:
                old, new = label[int(own[i])], label[int(own[j])]
                label = {g: new if x == old else x for g, x in label.items()}
            return {frozenset(g for g in label if label[g] == x) for x in label.values()}

        every = [(i, j) for i in range(25) for j in range(i) if near_copies.jaccard(sets[i], sets[j]) >= 0.8]
        assert joined(links) == joined(every) and len(links) == len({int(g) for g in own}) - len(joined(every))


def test_groups_equal_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = groups(texts)
    for piece in (1024, 20):
        assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df, piece=piece).collect()} == want


def test_stage_takes_what_three_bits_leave(spark, documents):
    """A copy at a five-word similarity over 0.8 whose fingerprints are far more than three bits apart."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = [f"w{i}" for i in range(200)]
    near, far = list(base), list(base)
    for at in (50, 90, 120, 160):
        near[at] = f"b{at}"
    for at in range(5, 200, 10):
        far[at] = f"q{at}"
    df = documents([(1, " ".join(base), "a"), (2, " ".join(near), "a"), (3, " ".join(far), "a")])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 3]
    apart = (simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(" ".join(near))) & (1 << 64) - 1
    assert apart.bit_count() > simhash.RADIUS


def test_odd_documents(spark, documents, odd):
    df = documents(odd, extra=True).withColumn("more", F.create_map(F.lit("a"), F.col("doc_id")))
    kept = simhash.deduplicated(df, near_copies.near_copies)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "6", "8", "None"]
    assert near_copies.near_copies(df.limit(0)).count() == 0


def family(n):
    """SimHashes within the radius of each other."""
    r = random.Random(5)
    center = r.getrandbits(near_copies.BITS)
    return [center ^ sum(1 << b for b in r.sample(range(near_copies.BITS), r.randint(0, 20))) for _ in range(n)]


def test_candidates_of_a_shard_come_from_its_tree(monkeypatch):
    """All of a small one; of a large one no more than it has nodes, so that links don't grow with the square of a group."""
    asked = []

    class Tree(simhash.BKTree):
        def within(self, value, radius):
            asked.append(radius)
            return super().within(value, radius)

    monkeypatch.setattr(near_copies, "BKTree", Tree)
    few, many = family(near_copies.ALL_PAIRS), family(400)
    near = lambda sims, i, j: (sims[i] ^ sims[j]).bit_count() <= near_copies.RADIUS
    assert {(min(p), max(p)) for p in near_copies.candidates(list(range(len(few))), few)} == {(i, j) for j in range(len(few)) for i in range(j) if near(few, i, j)}
    pairs = list(near_copies.candidates(list(range(400)), many))
    assert len(pairs) == 399 and {j for _, j in pairs} == set(range(1, 400)) and all(near(many, i, j) for i, j in pairs)
    groups = [i % 3 if i < 200 else 3 for i in range(400)]
    far = [x ^ (1 << near_copies.BITS) - 1 if g == 3 else x for x, g in zip(many, groups)]
    want = [any(near(far, i, j) and groups[i] != groups[j] for j in range(400)) for i in range(400)]
    assert near_copies.open_nodes(far, groups) == want and sum(want) == 200
    assert set(asked) == {near_copies.RADIUS}


def test_later_links_join_groups_and_not_nodes(spark, monkeypatch):
    """The second round of components gets links between groups that there are: fewer than the first."""
    seen = []
    monkeypatch.setattr(near_copies, "components", lambda edges: (seen.append({x for r in edges.collect() for x in r}), simhash.components(edges))[1])
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = near_copies.near_copies(df, piece=20)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == groups(texts)
    assert len(seen) == 2
    assert 0 < len(seen[1]) < len(seen[0])
