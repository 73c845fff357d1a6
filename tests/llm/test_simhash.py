"""Fingerprints and components against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from brightweir.llm import simhash

from .helpers import docs_of, rows


def plain_fingerprint(text, words):
    parts = (text or "").encode().lower().split()
    runs = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    """Smallest id reachable, by repeated relaxation over all pairs."""
    best = {i: i for i, _ in marks}
    changed = True
    while changed:
        changed = False
        for i, a in marks:
            for j, b in marks:
                if (a ^ b).bit_count() <= 4 and best[j] < best[i]:
                    best[i], changed = best[j], True
    return best


def test_pairs_within_four_bits_share_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    flips = np.zeros(3000, np.uint64)
    for _ in range(4):
        flips ^= np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)
    one, two = simhash.variant_keys(a.view(np.int64)), simhash.variant_keys((a ^ flips).view(np.int64))
    assert one.shape[1] == 143
    assert (one == two).any(axis=1).all()


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, 1, 0b1111}
    dense = [centre]
    for _ in range(150):
        dense.append(rng.choice(dense) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps | set(dense)})
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint").repartition(5)
    got = {r["fp"]: r["component"] for r in simhash.linked_components(df).collect()}
    expected = plain_components([(f, f & (2**64 - 1)) for f in signed])
    assert got == expected


def test_contract_rows(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = ["a b c", "A  b\tC", None, "", base, base + " tail", "one", " x é", base.upper(), "long " * 30_000]
    docs = docs_of(spark, *texts)
    docs = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("bigint")))
    got = simhash.simhash_components(docs)
    marks = [(i, plain_fingerprint(t, 4)) for i, t in enumerate(texts)]
    best = plain_components(marks)
    expected = [(i, f"{fp:016x}", best[i]) for i, fp in marks]
    expected += [expected[0], (None, expected[6][1], 6)]
    assert rows(got) == sorted(expected, key=repr)
    assert simhash.simhash_components(docs.where("false")).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(300)]
    near = list(base)
    near[10] = near[200] = "changed"
    texts = [" ".join(base), " ".join(near), " ".join(base), *(" ".join(word() for _ in range(300)) for _ in range(20)), None, ""]
    docs = docs_of(spark, *texts)
    nameless = docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("bigint"))
    kept = simhash.drop_near_copies(docs.unionByName(nameless))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [0, *range(3, 24)]
    assert kept.where("doc_id is null").count() == 1
    assert simhash.drop_near_copies(docs.where("false")).count() == 0


def test_a_hot_key_of_many_components(spark, monkeypatch):
    """5,000 fingerprints that agree in 30 bits: one bucket of theirs holds all of them."""
    monkeypatch.setattr(simhash, "HOT", 200)
    rng = np.random.default_rng(8)
    fixed = np.uint64((1 << 30) - 1)
    base = (rng.integers(0, 1 << 62, 2_500).astype(np.uint64) << np.uint64(2)) & ~fixed
    moved = base.copy()
    for _ in range(4):
        moved ^= np.uint64(1) << rng.integers(30, 64, len(base)).astype(np.uint64)
    fps = np.unique(np.concatenate((base, moved)) | np.uint64(12345)).view(np.int64)
    got = {r["fp"]: r["component"] for r in simhash.linked_components(spark.createDataFrame([(int(x),) for x in fps], "fp bigint")).collect()}
    name = {int(x): int(x) for x in fps}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for x in fps:
        near = fps[np.bitwise_count((fps ^ x).view(np.uint64)) <= 4]
        low = min(root(int(y)) for y in near)
        for y in near:
            name[root(int(y))] = low
    groups, want = {}, {}
    for x in map(int, fps):
        groups.setdefault(got[x], set()).add(x)
        want.setdefault(root(x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def shingled(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def word_fingerprints(text, seeds):
    words = set((text or "").encode().lower().split())
    hashes = [[xxhash.xxh64_intdigest(w, s) for w in words] for s in seeds]
    return [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in one) > len(one)) for one in hashes]


def test_near_groups_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    texts = [None, "", "  ", "one two", "ONE\ttwo", "word " * 40_000]
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(60, 300))
        texts.append(" ".join(base))
        for edits in (0, 1, 1, 2, 4, 8):
            near = list(base)
            for _ in range(edits):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near))
        texts.append(" ".join(rng.sample(base, len(base))))  # the same words in another order
    rng.shuffle(texts)
    docs = docs_of(spark, *texts).withColumns({c: F.lit("mine") for c in ("node", "lowest", "fp", "cluster", "grams", "group_id", "component")})
    docs = docs.unionByName(docs.where("doc_id % 10 = 0"))
    seeds = (42, 43)
    groups = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(docs, seeds=seeds).collect()}
    sets = [shingled(t) for t in texts]
    marks = [word_fingerprints(t, seeds) for t in texts]
    assert set(groups) == set(range(len(texts)))
    kept = sorted(set(groups.values()))
    assert all(groups[k] == k for k in kept) and len(kept) < len(texts) - 30
    for a in kept:
        for b in kept:
            near = any((x ^ y).bit_count() <= 4 for x, y in zip(marks[a], marks[b]))
            assert a >= b or not (near and alike(sets[a], sets[b]))
    for group in kept:
        members = {i for i, g in groups.items() if g == group}
        reached, waiting = {group}, [group]
        while waiting:
            at = waiting.pop()
            more = {m for m in members - reached if alike(sets[at], sets[m])}
            reached |= more
            waiting += more
        assert reached == members


def test_links_of_a_cluster_of_unlike_texts(spark):
    """One cluster, all in reach: 40 unlike sets and a copy of each third with one shingle more."""
    sets = {f"n{i:02}": list(range(100 * i, 100 * i + 20)) for i in range(40)}
    sets |= {f"m{i:02}": sets[f"n{i:02}"] + [-1] for i in range(0, 40, 3)}
    clusters = spark.createDataFrame([(1, n, int(n[1:]) + 100 * (n[0] == "m"), 0) for n in sets], "cluster bigint, node string, lowest bigint, fp bigint")
    table = spark.createDataFrame([(n, len(g), g) for n, g in sets.items()], "node string, n int, grams array<bigint>")
    tables = simhash.verified_links(clusters, table, 0.8, 12)
    assert len(tables) <= 3
    assert sorted((r["src"], r["dst"]) for t in tables for r in t.collect()) == [(f"m{i:02}", f"n{i:02}") for i in range(0, 40, 3)]


def test_linked_nodes_are_still_compared_with_others(spark):
    """A chain in which only neighbours are similar, and a fourth like the third alone."""
    sets = {f"n{i}": list(range(2 * i, 2 * i + 30)) for i in range(3)} | {"n3": [*range(5, 34), 99]}
    clusters = spark.createDataFrame([(1, n, i, 0) for i, n in enumerate(sets)], "cluster bigint, node string, lowest bigint, fp bigint")
    table = spark.createDataFrame([(n, len(g), g) for n, g in sets.items()], "node string, n int, grams array<bigint>")
    found = {(r["src"], r["dst"]) for t in simhash.verified_links(clusters, table, 0.87, 12) for r in t.collect()}
    assert found == {("n1", "n0"), ("n2", "n1"), ("n3", "n2")}


def test_copies_like_their_original_alone_are_not_all_compared(spark, monkeypatch):
    """60 copies, each with five shingles of its own, are like the original only; it bears no small id."""
    base = list(range(60))
    sets = {f"c{i:02}": [x for x in base if (x - i) % 60 not in (0, 7, 19, 31, 43)] + [1000 + 10 * i + k for k in range(5)] for i in range(60)} | {"o": base}
    clusters = spark.createDataFrame([(1, n, i, 0) for i, n in enumerate(sets)], "cluster bigint, node string, lowest bigint, fp bigint")
    table = spark.createDataFrame([(n, len(g), g) for n, g in sets.items()], "node string, n int, grams array<bigint>")
    kept, compared = simhash.saved, []

    def counted(df, name):
        out = kept(df, name)
        if name == "near-met":
            compared.append(out.count())
        return out

    monkeypatch.setattr(simhash, "saved", counted)
    found = {(r["src"], r["dst"]) for t in simhash.verified_links(clusters, table, 0.8, 12) for r in t.collect()}
    assert found == {("o", f"c{i:02}") for i in range(60)}
    assert sum(compared) <= 3 * len(sets)


def test_kinds_are_linked_in_one_search(spark, monkeypatch):
    """Fingerprints of two kinds never meet, and five seeds take as many searches for components as one."""
    a, b = 0x0F0F0F0F0F0F0F, 0x7A7A7A00000000
    near = [(0, a), (0, b), (1, a ^ 3), (1, b ^ 5), (1, b), (1, -1)]
    got = simhash.linked_components(spark.createDataFrame(near, "kind int, fp bigint"), kinds=2).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["component"], set()).add(r["fp"])
    assert sorted(map(sorted, groups.values())) == sorted([[-1], [a ^ 3], [a], [b, b ^ 5]])
    words = [f"w{i}" for i in range(40)]
    docs = docs_of(spark, " ".join(words), " ".join([*words, "more"]), "other words", None)
    kept, searched = simhash.connected_components, []
    monkeypatch.setattr(simhash, "connected_components", lambda *a: searched.append(1) or kept(*a))
    calls = []
    for seeds in ((42,), (42, 43, 44, 45, 46)):
        searched.clear()
        simhash.near_groups(docs, seeds=seeds).collect()
        calls.append(len(searched))
    assert calls[1] <= calls[0] + 1
