"""N-gram Jaccard join and embedding near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest

from strataq.llm import embedding_dedup, jaccard_join, shared


def parts(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = [None, "", " \t\n", "One", "one", "one two", "ONE\ttwo", "Élan", "élan", "a\xa0b c", "x " * 3000]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([4, 9, 12, 30, 60, 200]))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy[len(copy) // 2 : len(copy) // 2] = passage
            if rng.random() < 0.3:
                copy.append(rng.choice(words))
            texts.append(" ".join(copy))
    texts += texts[20:30]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("group", [None, 400])
def test_jaccard_components(spark, n, percent, group, monkeypatch):
    if group:
        monkeypatch.setattr(jaccard_join, "GROUP", group)
    monkeypatch.setattr(jaccard_join, "OFTEN", 8)
    texts = corpus()
    sets = [shingles(t, n) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert len(pairs) > 40
    want = parts(len(sets), pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, n=n, percent=percent).collect()}
    assert got == {k: (len(sets[k]), want[k]) for k in range(len(sets))}


def test_signatures_meet():
    """Any two linked sets share a signature, with and without popular hashes."""
    rng = np.random.default_rng(5)
    for percent in (90, 80):
        classes = jaccard_join.Classes(percent)
        for _ in range(400):
            n = int(rng.integers(2, 300))
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, max(1, n * (100 - percent) // 100 + 1)))
            y = np.unique(np.concatenate([x[drop:], rng.integers(0, 2**63, int(rng.integers(0, drop + 2))).astype(np.uint64)]))
            inter = len(np.intersect1d(x, y))
            if inter == len(x) == len(y) or 100 * inter < percent * (len(x) + len(y) - inter):
                continue
            for share in (0, 0.3, 0.6, 0.9, 1):
                popular = np.sort(x[rng.random(len(x)) < share])
                a, b = (np.concatenate([*jaccard_join.signatures(s, classes, popular), np.empty(0, np.uint64)]) for s in (x, y))
                assert len(np.intersect1d(a, b)), (percent, len(x), len(y), share)


def test_jaccard_empty_and_odd_rows(spark):
    schema = "doc_id long, text string, node long, comp string"
    assert jaccard_join.jaccard_components(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d", 5, "x"), (1, "a b c d", 6, "y"), (None, "a b c d", 7, "z"), (9, "A b c d", 8, None), (4, None, 1, None)]
    got = sorted(jaccard_join.jaccard_components(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("1", 2, "1"), ("1", 2, "1"), ("4", 0, "4"), ("9", 2, "1"), ("None", 2, "None")]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 480)]
    want = parts(500, pairs)
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: want[k] for p in pairs if p[0] != p[1] for k in p}
    assert shared.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("tree,tables", [(1 << 20, 2), (100, None), (0, None)])
def test_components_end_in_one_task(spark, tree, tables, monkeypatch):
    """Rounds over all tasks, each of many shuffles that the driver holds, once went on for tables that one task joins."""
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 480)]
    want, stored, store = parts(500, pairs), [], shared.store
    monkeypatch.setattr(shared, "TREE", tree, raising=False)
    monkeypatch.setattr(shared, "store", lambda df: stored.append(1) or store(df))
    got = sorted((r.node, r.component) for r in shared.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == sorted({(k, want[k]) for p in pairs if p[0] != p[1] for k in p})
    assert len(stored) == tables if tables else len(stored) > 2


def test_stars_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(2, 40)
        pairs = [tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(0, 50))]
        want = parts(n, pairs)
        lo, hi = shared.stars(*np.array(pairs, np.int64).reshape(-1, 2).T)
        assert sorted(zip(hi.tolist(), lo.tolist())) == sorted({(k, want[k]) for p in pairs for k in p if want[k] != k})


@pytest.mark.parametrize("blocks", [(4096, 16384), (7, 9)])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_dedup(spark, blocks, kind, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "HOME_BLOCK", blocks[0])
    monkeypatch.setattr(embedding_dedup, "GUEST_BLOCK", blocks[1])
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8)).astype(np.float32)
    vectors = [v for b in base for v in (b + rng.normal(size=(rng.integers(1, 6), 8)).astype(np.float32) * 0.12)]
    vectors += [base[0] * 3, base[0] * 3, base[0] * 1e-30, base[1] * 1e30]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 8, [1.0, None, *[0.0] * 6], [float("nan")] * 8, [float("inf"), *[1.0] * 7], [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + k, v) for k, v in enumerate(odd)]
    unit = [np.array(v) / np.linalg.norm(v) for v in (np.array(x[1], float) / max(map(abs, x[1])) for x in rows[: len(vectors)])]
    n = len(vectors)
    pairs = [(a, b) for a in range(n) for b in range(a) if unit[a] @ unit[b] >= 0.95]
    want = parts(n, pairs)
    links = [sum(k in p for p in pairs) for k in range(n)]
    rows.append((None, [1.0] * 8))
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(df).collect()}
    expect = {k: (links[k], want[k], want[k] == k) for k in range(n)}
    expect |= {1000 + k: (0, 1000 + k, True) for k in range(6)} | {1006: (1, 1006, True), 1007: (1, 1006, False), None: (0, None, True)}
    assert got == expect


def test_embedding_bounds():
    """No pair at the threshold falls outside its quantisation bound."""
    rng = np.random.default_rng(4)
    x = embedding_dedup.unit(rng.normal(size=(200, 16)))
    q, scale, err = embedding_dedup.quantise(x)
    approx = (q.astype(int) @ q.T.astype(int)) * scale[:, None] * scale[None]
    bound = err[:, None] + err[None] * (1 + err[:, None])
    assert (np.abs(approx - x @ x.T) <= bound).all()


def test_embedding_empty(spark):
    assert embedding_dedup.dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_large_groups_of_copies(spark, monkeypatch):
    """A group far above a block: copies of one text with a few changes each, a second text that shares words with them, and
    chains whose ends don't link."""
    monkeypatch.setattr(jaccard_join, "GROUP", 3000)
    monkeypatch.setattr(jaccard_join, "FEW", 10)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(60)]
    other = base[:30] + [f"o{k}" for k in range(40)]
    texts = []
    for k in range(150):
        copy = list(base if k % 3 else other)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(500)}"
        texts.append(" ".join(copy))
    chain = [f"c{k}" for k in range(80)]
    texts += [" ".join(chain[k : k + 60]) for k in range(0, 20, 2)]
    sets = [shingles(t, 3) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = parts(len(sets), pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) < 100


def test_very_long_texts_join(spark):
    words = [f"w{k}" for k in range(150_000)]
    texts = [" ".join(words), " ".join(words[:140_000] + ["y"] * 3), "a b c"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (149_998, 0), 1: (140_001, 0), 2: (1, 2)}


def test_many_short_sets_of_one_group():
    """The walk follows only the sets that share rare tokens: no work in the square of a group."""
    import time

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**62, 4000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, 20, replace=False)) for _ in range(40_000)]
    began = time.time()
    assert len(set(jaccard_join.trie_components(sets, 80).tolist())) == 40_000
    assert time.time() - began < 30


def test_trie_components_against_brute_force():
    rng = np.random.default_rng(9)
    for percent in (50, 80, 90):
        for n, pool in ((60, 12), (60, 30), (80, 200)):
            sets = [np.unique(rng.integers(0, pool, int(rng.integers(1, 14)))).astype(np.uint64) for _ in range(n)]
            pairs = [(a, b) for a in range(n) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]
            assert jaccard_join.trie_components(sets, percent).tolist() == parts(n, pairs)
            labels = [k % 7 for k in range(n)]
            known = [(a, b) for a in range(n) for b in range(a) if labels[a] == labels[b]]
            assert jaccard_join.trie_components(sets, percent, labels).tolist() == parts(n, pairs + known)


def test_attach_equals_a_left_join(spark):
    rows = spark.createDataFrame([(1, k) for k in range(300)] + [(2, 0), (3, 1), (None, 2)] + [(9, k) for k in range(80)], "k long, v long")
    facts = spark.createDataFrame([(1, "a", 300), (2, "b", 1), (7, "c", 0)], "k long, f string, n long")
    got = sorted((str(r.k), r.v, str(r.f)) for r in shared.attach(rows, facts, ["k"], "n", 50).collect())
    assert got == sorted((str(r.k), r.v, {1: "a", 2: "b"}.get(r.k, "None")) for r in rows.collect())


def test_no_folder_on_a_cluster():
    class Far:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError):
        shared.folder(Far)
