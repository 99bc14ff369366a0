"""SimHash groups against brute force, with bounded trees that a group overflows."""

import random
import re

import xxhash
from plumbline.llm import simhash


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_fingerprints():
    r = random.Random(1)
    for text in ("", " \n", "One", "a b", "É a\tb\x0bc A B", *(" ".join(r.choice("abc") for _ in range(n)) for n in (3, 50, 70_000))):
        assert simhash.fingerprint(text) & 0xFFFFFFFFFFFFFFFF == slow_fingerprint(text)


def test_tree():
    r = random.Random(2)
    values = [r.getrandbits(12) for _ in range(400)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 97):
        assert sorted(tree.values[i] for i in tree.within(q, 3)) == sorted(v for v in values if (v ^ q).bit_count() <= 3)


def test_groups_equal_brute_force(spark):
    """A hot group of near fingerprints, cut into many small trees, and chains of links."""
    r = random.Random(3)
    center = r.getrandbits(64)
    fps = [center ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(150)] + [r.getrandbits(64) for _ in range(50)]
    chain = r.getrandbits(64)
    for b in range(0, 60, 3):
        fps.append(chain := chain ^ (7 << b))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    labels = {row["v"]: row["f"] for row in simhash.components(simhash.links(df, tree_size=16)).collect()}
    want = groups(dict(zip(signed, fps)))
    assert {f: labels.get(f, f) for f in signed} == want


def test_documents(spark, documents, odd):
    df = documents(odd, extra=True)
    found = {(row["doc_id"], row["fp"]): row["component_id"] for row in simhash.near_duplicates(df).collect()}
    fps = {i: slow_fingerprint(t) for i, t, _ in odd if i is not None}
    for (i, _), component in found.items():
        if i is not None:
            assert component == groups(fps)[i]
    assert [c for (i, _), c in found.items() if i is None] == [4]
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(str(row["doc_id"]) for row in kept.collect()) == ["1", "3", "4", "6", "8", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.deduplicated(df.limit(0)).count() == 0
