import random

import pytest

from canopy.llm import minhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    ids = [i for i, _ in rows]
    sets, root = [shingles(t) for _, t in rows], {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = top(ids[a]), top(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: (len(s), top(i), top(i) == i) for i, s in zip(ids, sets)}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (6, "one two three")]
    for _ in range(20):
        base = [word() for _ in range(rng.randint(30, 150))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) + 1, " ".join(copy)))
    # a star: copies link with the hub only
    hub = [word() for _ in range(100)]
    rows.append((len(rows) + 1, " ".join(hub)))
    for k in range(30):
        copy = list(hub)
        copy[10 + 2 * k] = word()
        rows.append((len(rows) + 1, " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("region", [4096, 8])
def test_against_brute_force(docs_of, region):
    """The small region size sends the star through deeper prefixes, chunks, and blocks of what is left."""
    rows = corpus(region)
    found = minhash.near_duplicates(docs_of(rows).withColumnRenamed("lang", "bucket"), 85, region_docs=region).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == brute(rows)


def test_odd_tables(docs_of):
    assert minhash.near_duplicates(docs_of([])).count() == 0 == minhash.keep_one(docs_of([])).count()
    text = "a b c d e f g h i j"
    rows = [(7, text), (7, text), (None, text), (3, text), (9, "x" * 200_000 + " y" * 3), (None, "q w e r t y"), (None, "q w e r t y"), (5, None), (5, ""), (None, None)]
    docs = docs_of(rows).withColumnsRenamed({"lang": "a.b", "source": "Row_No"})
    found = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(docs).collect())
    three = [("7", "3", False), ("7", "3", False), ("None", "3", False), ("3", "3", True)]
    no_ids = [("None", "None", True), ("None", "None", False)]
    assert found == sorted(three + no_ids + [("9", "9", True), ("5", "5", True), ("5", "5", True), ("None", "None", True)])
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str((r["doc_id"], (r["text"] or "")[:3])) for r in kept.collect()) == sorted(str(x) for x in [(3, "a b"), (9, "xxx"), (None, "q w"), (5, ""), (5, ""), (None, "")])


def test_many_rows_without_an_id(docs_of):
    """Texts that share an id, or have none, are documents of their own."""
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(1500)]
    rows = [(None if k % 2 else 1, t) for k, t in enumerate(texts)] + [(2, texts[0]), (None, texts[1])]
    out = minhash.near_duplicates(docs_of(rows)).collect()
    assert sum(r["component_id"] is None for r in out) == 751 and sum(r["kept"] for r in out) == 1500
    assert [(r["component_id"], r["kept"]) for r in out if r["doc_id"] == 2] == [(1, False)]


def test_blocks_join_every_component():
    """Block links find what brute force finds between components that a first pass left apart."""
    import numpy as np

    rng = np.random.default_rng(8)
    for _ in range(30):
        n = 40
        near = np.triu(rng.random((n, n)) < 0.05, 1)
        near |= near.T

        class Given:
            def linked(self, one, others):
                return others[near[one, others]]

        asks, component = np.arange(n) < 15, np.arange(n) // rng.integers(1, 4)
        links = minhash.block_links(np.arange(n), asks, component, Given())
        assert all(near[a, b] for a, b in links)
        want, got = set(), set()
        for edges, out in ((zip(*np.nonzero(near & asks[:, None] & ~asks[None])), want), (links, got)):
            root = component.copy()
            for a, b in edges:
                root[root == root[a]] = root[b]
            out |= {(i, j) for i in range(n) for j in range(n) if root[i] == root[j]}
        assert want == got


def test_stage_links_from_80_percent(spark, docs_of):
    """Pairs whose similarity is on either side of 0.80, through the pipeline's stage; brute force says which are copies."""
    import corpus_pipeline

    rng = random.Random(80)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, copies, between = [], set(), 0
    for k in range(300):
        base = [word() for _ in range(500)]
        copy = list(base)
        for at in rng.sample(range(0, 500, 10), rng.randint(8, 14)):
            copy[at] = word()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        if 100 * len(a & b) >= 80 * len(a | b):
            copies.add(2 * k + 1)
            between += 100 * len(a & b) < 85 * len(a | b)
    assert between > 50 and len(copies) < 300
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs_of(rows).withColumnRenamed("lang", "a.b"), "").collect()}
    dropped = {i for i, _ in rows} - left
    assert dropped <= copies and len(dropped) >= 0.99 * len(copies)


def test_trees_follow_the_bound():
    assert minhash.depths_for(85) == (3, 4, 6) and minhash.depths_for(80) == (3, 4, 5)
    for percent in range(60, 100, 5):
        last = minhash.depths_for(percent)[-1]
        assert (1 - (percent / 100) ** last) ** (minhash.HASHES // last) <= minhash.MISSED
