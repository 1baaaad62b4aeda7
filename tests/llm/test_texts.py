"""Line dedup, decontamination, toxicity, quality, and the pipeline."""

import random

import pytest

from canopy.llm import decontaminate, linededup, linear, quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


def prose(rng, n):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    return " ".join(w + ("." if rng.random() < 0.15 else "") for w in words)


def test_line_dedup(docs_of):
    rng = random.Random(3)
    passage, line, phrase = prose(rng, 90), prose(rng, 30), prose(rng, 9)
    rows = [(k, f"{prose(rng, 60)}\n{passage}\n{prose(rng, 40)}") for k in range(1, 6)]
    rows += [(k, f"{prose(rng, 50)} {passage} {prose(rng, 50)}") for k in range(6, 9)]
    lined = [(k, f"{prose(rng, 80)}\n{line}\n{prose(rng, 20)}") for k in range(10, 16)]
    clean = [(k, f"{prose(rng, 80)}\n{phrase}\n{prose(rng, 30)} {line.split()[0]} {phrase}") for k in range(50, 56)]
    whole = prose(rng, 200)
    copies = [(20, whole), (21, whole), (22, whole)]
    odd = [(30, None), (31, ""), (32, "\n\n"), (33, "a b c"), (33, "a b c"), (40, "no\n" * 400), (None, f"x y\n{passage}"), (41, "\u6f22\u5b57" * 300_000)]
    made = docs_of(rows + lined + clean + copies + odd).withColumnsRenamed({"lang": "a.b", "source": "n_removed"})
    out = linededup.remove_repeats(made, report=True)
    assert out.columns == ["doc_id", "text", "a.b", "n_chars", "n_removed", "removed_runs"]
    out = out.collect()
    texts = {r["doc_id"]: r["text"] for r in out}
    assert len(out) == made.count()
    holders = [r["doc_id"] for r in out if r["text"] and passage in r["text"]]
    assert holders == [None]  # a null id comes first
    for k, t in rows:
        before, after = t.split(passage)
        assert before.strip() in texts[k] and after.strip() in texts[k] and len(texts[k]) <= len(before) + len(after) + 2
    assert texts[10] == dict(lined)[10] and all(texts[k] == t.replace(line + "\n", "") for k, t in lined[1:])
    assert all(texts[k] == t for k, t in clean)
    assert texts[20] == whole and texts[21] == texts[22] == ""
    assert texts[30] is None and texts[31] == "" and texts[32] == "\n\n" and texts[33] == "a b c" and len(texts[41]) == 600_000
    assert len(texts[40].split()) < 200
    assert all(r["n_chars"] == len(r["text"]) for r in out if r["text"] is not None)
    assert linededup.remove_repeats(docs_of([])).count() == 0
    plain = linededup.remove_repeats(made)
    assert plain.columns == made.columns and sum(r["n_removed"][0] == "s" for r in plain.collect()) == made.count()


def test_line_dedup_against_brute_force(docs_of):
    """Passages in varying selections, at line ends and in mid-line: what goes is there before, and what is there before goes."""
    rng = random.Random(31)
    passages = [prose(rng, rng.randint(51, 120)) for _ in range(12)]
    rows = []
    for k in range(120):
        parts = [prose(rng, rng.randint(20, 60))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            parts += [rng.choice([" ", "\n"]) + p + rng.choice([" ", "\n"]), prose(rng, rng.randint(10, 40))]
        rows.append((k, "".join(parts)))
    out = {r["doc_id"]: r for r in linededup.remove_repeats(docs_of(rows), report=True).collect()}
    seen, planted, left = "", 0, 0
    for k, t in rows:
        for run in filter(None, out[k]["removed_runs"].split(",")):
            start, end = map(int, run.split(":"))
            assert t[start:end].strip() in seen or t.count(t[start:end].strip()) > 1
            assert len(t[start:end].split()) >= linededup.LINE_WORDS
        for p in passages:
            if p in t and p in seen:
                planted += 1
                words = p.split()
                kept = sum(" ".join(words[j : j + 20]) in out[k]["text"] for j in range(len(words) - 19))
                left += kept > 0
        if not any(p in t for p in passages):
            assert out[k]["text"] == t
        seen += "\n\n" + t
    assert planted > 60 and left <= 0.02 * planted


def test_fingerprints_are_winnowed():
    """A run of window_words words in whole parts has a fingerprint in common wherever it stands."""
    rng = random.Random(32)
    for _ in range(60):
        same = prose(rng, 90)
        a, b = f"{prose(rng, 30)} {same} {prose(rng, 30)}", f"{prose(rng, 11)}\n{same}\n{prose(rng, 17)}"
        text, fp, at = linededup.fingerprints([a, b, "", "x"], 20, 40, 12)
        own = [set(fp[text == k].tolist()) for k in range(2)]
        assert len(own[0] & own[1]) >= 2
        alone = linededup.fingerprints([b], 20, 40, 12)
        assert alone[1].tolist() == fp[text == 1].tolist() and alone[2].tolist() == at[text == 1].tolist()


def test_runs_are_maximal():
    rng = random.Random(4)
    for _ in range(50):
        same = prose(rng, 80)
        a, b = f"{prose(rng, 10)} {same} {prose(rng, 10)}", f"{prose(rng, 5)} {same} {prose(rng, 5)}"
        start = b.index(same) + same.index(" ") + 1
        found = linededup.shared_runs(linededup._Text(a), linededup._Text(b), [(start, a.index(same) + same.index(" ") + 1)], 50, 60)
        assert len(found) == 1 and found[0][0] <= b.index(same) and found[0][1] >= b.index(same) + len(same)
    # too short to go from within a line, long enough as lines of its own
    row = " ".join(f"w{k}" for k in range(14))
    runs = lambda a, b, places: [b[s:e] for s, e in linededup.shared_runs(linededup._Text(a), linededup._Text(b), places, 20, 12)]
    assert runs(f"a {row} b", f"c {row} d", [(2, 2)]) == []
    assert runs(f"a\n{row}\nb", f"c\n{row}\nd", [(2, 2)]) == [row]
    # other line ends and blanks between the same words
    long = prose(rng, 30).split()
    assert runs(f"a {' '.join(long)} b", f"c\n{chr(10).join(long)}  d", [(2, 2)]) == ["\n".join(long)]


def test_alignment_against_the_full_table():
    import numpy as np

    def full(t, i):
        h = np.zeros((len(t) + 1, len(i) + 1), int)
        for a in range(1, len(t) + 1):
            for b in range(1, len(i) + 1):
                h[a, b] = max(0, h[a - 1, b - 1] + (2 if t[a - 1] == i[b - 1] else -1), h[a - 1, b] - 1, h[a, b - 1] - 1)
        return h.max()

    rng = np.random.default_rng(1)
    for _ in range(150):
        t, i = rng.integers(0, 5, rng.integers(1, 30)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 20)).astype(np.uint64)
        score, start, end = decontaminate.align(t, i)
        assert score == full(t, i) and (not score or full(t[start:end], i) == score)


@pytest.mark.parametrize("most", [500_000, 50])
def test_decontamination(spark, docs_of, most):
    """A benchmark of one block and of many."""
    rng = random.Random(5)
    items = [(k, prose(rng, 40)) for k in range(8)]
    edited = items[2][1].split()
    for k in range(4, 40, 6):
        edited[k] = "changed"
    rows = [(1, f"{prose(rng, 50)} {items[0][1].upper()} {prose(rng, 50)}"), (2, " ".join(edited)), (3, prose(rng, 100)), (4, None), (5, ""), (6, items[5][1]), (None, items[6][1])]
    rows += [(None, prose(rng, 50)), (6, prose(rng, 50)), (6, items[5][1]), (7, f"{prose(rng, 30)} it has three short words {prose(rng, 30)}"), (8, prose(rng, 60_000))]
    rows += [(k, f"{prose(rng, 30)} {items[7][1]}") for k in range(100, 200)]
    rows += [(400, " ".join(items[1][1].split()[:8]) + prose(rng, 60)), (401, f"{prose(rng, 9)} second text under one and the same number {prose(rng, 9)}")]
    benchmark = spark.createDataFrame(
        [*items, (50, None), (51, ""), (None, "xx"), (52, "two words"), (53, "three short words"), (3, "second text under one and the same number"), (54, "...")], "item_id long, text string"
    )
    docs = docs_of(rows).withColumnsRenamed({"lang": "item_id", "source": "a.b"})
    found = decontaminate.contaminated(docs, benchmark, most_words=most).collect()
    want = [(1, 0), (2, 2), (6, 5), (6, 5), (None, 6), (7, 53), (401, 3)] + [(k, 7) for k in range(100, 200)]
    assert sorted(str((r["doc_id"], r["item_id"])) for r in found) == sorted(map(str, want))
    kept = decontaminate.keep_clean(docs, benchmark, most_words=most)
    assert kept.columns == docs.columns
    assert sorted(str((r["doc_id"], r["text"] and r["text"][:20])) for r in kept.collect()) == sorted(
        str((i, t and t[:20])) for i, t in rows if i in (3, 4, 5, 8, 400) or t in (rows[7][1], rows[8][1])
    )
    assert decontaminate.contaminated(docs_of([]), benchmark).count() == 0 == decontaminate.keep_clean(docs_of([]), benchmark).count()
    assert decontaminate.keep_clean(docs_of(rows), benchmark.where("false")).count() == len(rows)


def test_decontamination_against_brute_force(spark, docs_of):
    """Every document that shares a four-word gram with an item, aligned with it over its whole text."""
    rng = random.Random(51)
    items = [(k, prose(rng, rng.randint(4, 50))) for k in range(15)]
    rows = []
    for k in range(150):
        own = rng.choice(items)[1].split()
        low = rng.randint(0, len(own) - 1)
        part = [w if rng.random() > rng.choice([0, 0.1, 0.3]) else "other" for w in own[low : low + rng.randint(2, 50)]]
        rows.append((k, f"{prose(rng, rng.randint(0, 60))} {' '.join(part)} {prose(rng, rng.randint(0, 60))}"))
    want = set()
    for i, t in rows:
        for j, item in items:
            a, b = decontaminate.words(t), decontaminate.words(item)
            grams = lambda w: {tuple(w[x : x + 4]) for x in range(len(w) - 3)}
            if grams(a) & grams(b):
                score, _, _ = decontaminate.align(decontaminate.hashes(t), decontaminate.hashes(item))
                if score >= 0.5 * 2 * len(b):
                    want.add((i, j, score))
    found = decontaminate.contaminated(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in found} == want and len(want) > 40


def test_hot_copies_beside_an_exact_one(spark, docs_of):
    """Edited and partial copies that share no seed with what only the one exact copy holds."""
    item = [f"w{k}" for k in range(40)]
    edited = " ".join(item[:24] + ["other"] + item[25:])
    partial = " ".join(item[:24])
    rows = [(1, " ".join(item))]
    rows += [(100 + k, f"a{k} b{k} {edited} c{k}") for k in range(150)]
    rows += [(300 + k, f"a{k} b{k} {partial} c{k}") for k in range(150)]
    # a common phrase of the item alone is no copy
    rows += [(500 + k, f"a{k} {' '.join(item[5:12])} b{k}") for k in range(150)]
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["share"] for r in decontaminate.contaminated(docs_of(rows), benchmark).collect()}
    assert set(found) == {(i, 7) for i, _ in rows if i < 500} and min(found.values()) >= 0.5
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs_of(rows), benchmark).collect()} == {i for i, _ in rows if i >= 500}


def labelled(rng, n, first=0):
    rows, labels = [], []
    for k in range(first, first + n):
        toxic, good = rng.random() < 0.2, rng.random() < 0.7
        text = prose(rng, 60) + (" scum moron " * 2 if toxic else "")
        if not good:
            text = " | ".join(text.split()) + " %%% $$$" * 10
        rows.append((k, text))
        labels.append((k, int(good), int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_texts(spark, docs_of):
    rng = random.Random(6)
    rows, labels = labelled(rng, 500)
    train = spark.createDataFrame(labels[:350] + [(None, 1, 1), (3, None, 1)], LABELS)
    extra = [(1000, None), (1001, ""), (5, rows[5][1]), (None, "scum moron scum moron"), (1002, prose(rng, 100_000))]
    docs = docs_of(rows + extra).withColumnsRenamed({"lang": "toxic", "source": "a.b"})
    out = toxicity.classify(docs, train).collect()
    assert len(out) == len(rows) + 5
    flagged = {r["doc_id"]: r["is_toxic"] for r in out}
    truth = {k: bool(t) for k, _, t in labels[350:]}
    assert sum(flagged[k] == t for k, t in truth.items()) >= 0.97 * len(truth)
    assert not flagged[1000] and not flagged[1001] and flagged[None]
    kept = toxicity.keep_clean(docs, train)
    assert kept.columns == docs.columns and kept.count() == sum(not r["is_toxic"] for r in out)
    none = toxicity.classify(docs_of(rows), train.where("false")).collect()
    assert len(none) == 500 and not any(r["is_toxic"] for r in none)
    assert toxicity.classify(docs_of([]), train).count() == 0
    # by brute force: one text after the other through the chain
    chain = toxicity.fit_chain(docs, train)
    wide = len(chain.vocabulary)
    for r, t in zip(toxicity.score(docs_of(rows[:40]), chain).collect(), [t for _, t in rows[:40]]):
        earlier, chances = [], []
        for m in chain.models:
            margin = m[-1] + sum(m[chain.vocabulary[w]] for w in set(toxicity.words(t)) if w in chain.vocabulary)
            margin += sum(x * e for x, e in zip(m[wide:-1], earlier))
            earlier.append(min(8, max(-8, margin)))
            chances.append(float(linear.sigmoid(margin)))
        assert chances == pytest.approx([r["p_review"], r["p_toxic"], r["p_toxic_junk"]]) and r["is_toxic"] == (chances[1] >= chain.threshold)


def test_copies_share_a_fold(spark, docs_of):
    import numpy as np

    rng = random.Random(61)
    rows, labels = labelled(rng, 60)
    rows += [(100 + k, t) for k, t in rows]
    labels += [(100 + k, q, t) for k, q, t in labels]
    train = toxicity.categories(spark.createDataFrame(labels, LABELS))
    sample = linear.encode_sample(linear.labelled_sample(docs_of(rows), train, 1000), toxicity.words, toxicity.CATEGORIES, 50)
    assert len(sample) == 120 and len(set(sample.hashes.tolist())) == 60
    x, y = linear.matrix(sample, np.zeros((120, 0))), sample.labels["toxic"]
    out = linear.out_of_fold(x, y, sample.hashes, 3)
    fold = sample.hashes % 3
    for k in range(3):
        assert np.allclose(out[fold == k], x[fold == k] @ linear.fit(x[fold != k], y[fold != k]))


def test_quality_on_held_out_texts(spark, docs_of):
    rng = random.Random(7)
    rows, labels = labelled(rng, 400)
    train = spark.createDataFrame(labels[:250], LABELS)
    docs = docs_of(rows + [(1000, None), (1001, "")])
    out = {r["doc_id"]: r for r in quality.score(docs, train, docs["source"], docs["lang"]).collect()}
    assert len(out) == 402
    assert sum(out[k]["keep"] == bool(q) for k, q, _ in labels[250:]) >= 0.97 * 150
    empty = docs_of([])
    assert quality.score(empty, train, empty["source"], empty["lang"]).count() == 0
    none = quality.score(docs, train.where("false"), docs["source"], docs["lang"])
    assert none.where("keep").count() == 402


def test_sparse_sites_shrink(spark):
    rows = [(k, "fine text here", "en", "big", 0) for k in range(200)] + [(k, "| | %%%", "en", "bad", 0) for k in range(200, 400)] + [(900, "fine text here", "en", "tiny", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, int(k < 200), 0) for k in range(0, 400, 2)], LABELS)
    out = {r["doc_id"]: r for r in quality.score(docs, labels, docs["source"], docs["lang"]).collect()}
    assert out[1]["path_rate"] > 0.9 and out[201]["path_rate"] < 0.1
    assert 0.3 < out[900]["path_rate"] < 0.7  # only the prior is left of a site of one


def test_site_posteriors_against_brute_force(spark, docs_of):
    """Shares, priors and posteriors worked out one row at a time; rows repeat, and columns have odd names."""
    import math

    rng = random.Random(71)
    rows, labels = labelled(rng, 300)
    rows += rows[:20] + [(None, prose(rng, 20)), (None, None), (2000, prose(rng, 50_000))]
    docs = docs_of(rows).selectExpr("*", "0 AS evidence").withColumnRenamed("n_chars", "a.b")
    host, path = docs["source"], docs["doc_id"] % 4
    out = quality.score(docs, spark.createDataFrame(labels[:200], LABELS), host, path).collect()
    assert len(out) == len(rows)
    base = linear.logit(quality.fit_style(docs, spark.createDataFrame(labels[:200], LABELS)).base)
    p = [1 / (1 + math.exp(-(r["evidence"] + base))) for r in out]
    total, mean = len(out), sum(p) / len(out)

    def pooled(key):
        sums = {}
        for r, x in zip(out, p):
            n, good = sums.get(key(r), (0, 0.0))
            sums[key(r)] = n + 1, good + x
        return sums

    def strength(variance, sites):
        between = max(variance - mean * (1 - mean) * sites / total, 1e-9)
        return min(max(mean * (1 - mean) / between - 1, 1.0), 10_000.0)

    hosts, paths = pooled(lambda r: r["host"]), pooled(lambda r: (r["host"], r["path"]))
    of_hosts = strength(sum(n * (g / n - mean) ** 2 for n, g in hosts.values()) / total, len(hosts))
    of_paths = strength(sum(n * (g / n - hosts[h][1] / hosts[h][0]) ** 2 for (h, _), (n, g) in paths.items()) / total, len(paths))
    for r, x in zip(out, p):
        n, good = hosts[r["host"]]
        host_rate = (good - x + of_hosts * mean) / (n - 1 + of_hosts)
        n, good = paths[r["host"], r["path"]]
        path_rate = (good - x + of_paths * host_rate) / (n - 1 + of_paths)
        score = 1 / (1 + math.exp(-(r["evidence"] + math.log(path_rate / (1 - path_rate)))))
        assert (r["host_rate"], r["path_rate"], r["score"]) == pytest.approx((host_rate, path_rate, score), rel=1e-6) and r["keep"] == (r["score"] >= 0.5)


def test_fit_finds_the_signal():
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 2, (500, 5)), np.ones(500)]).astype(float)
    y = (x[:, 0] > 0).astype(float)
    assert linear.fit(x, y)[0] > 3 and abs(linear.fit(x, y)[1:5]).max() < 1
    assert linear.best_threshold(np.array([0.9, 0.8, 0.1]), np.array([1.0, 1, 0])) == pytest.approx(0.45)
    assert linear.best_threshold(np.zeros(3), np.zeros(3)) > 1


def test_pipeline(spark, tmp_path):
    """Every stage on what the one before kept, against brute force; odd rows and columns go through all of them."""
    import corpus_pipeline
    from test_minhash import shingles
    from test_packing import brute as packed

    rng = random.Random(81)
    passage, item = prose(rng, 80), prose(rng, 40)
    rows, labels = labelled(rng, 300)
    toxic = {k for k, _, t in labels if t}
    rows = [(k, t) for k, t in rows if "%%%" not in t]
    rows += [(1000 + k, f"{prose(rng, 50)} {passage} {prose(rng, 30)}") for k in range(5)]
    base = prose(rng, 200).split()
    rows += [(1100 + k, " ".join(w if j != 20 * k else "new" for j, w in enumerate(base))) for k in range(6)]
    rows += [(1200, f"{prose(rng, 40)} {item} {prose(rng, 40)}"), (None, f"{item} {prose(rng, 5)}"), (None, prose(rng, 60)), (1300, None), (1301, ""), (1302, prose(rng, 3000))]
    rows += [(7000, "said once and again"), (7000, "said once and again")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, runs int, is_toxic string, row_no int"
    docs = spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), "x", 1, "no", k) for k, (i, t) in enumerate(rows)], schema)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels[:250], LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    at, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["row_no"]: r for r in at.collect()}
        at = corpus_pipeline.materialize(stage(spark, at, folder))
        assert at.columns == docs.columns, name
        kept[name] = before, {r["row_no"]: r for r in at.collect()}
    before, after = kept["toxicity"]
    gone = {before[k]["doc_id"] for k in before.keys() - after.keys()}
    assert len(gone & toxic) >= 0.95 * len(toxic & {r["doc_id"] for r in before.values()}) and len(gone - toxic) <= 5
    before, after = kept["line_dedup"]
    assert before.keys() == after.keys()
    assert sum(passage in (r["text"] or "") for r in after.values()) == 1
    changed = {after[k]["doc_id"] for k in after if after[k]["text"] != before[k]["text"]}
    assert changed <= {1001, 1002, 1003, 1004, *range(1101, 1106), None, 1200} and changed >= {1001, 1002, 1003, 1004}
    before, after = kept["near_dedup"]
    assert after.keys() <= before.keys()
    sets = {k: shingles(r["text"]) for k, r in before.items()}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0
    order = sorted(before, key=lambda k: (before[k]["doc_id"] is None, before[k]["doc_id"] or 0, k))
    assert all(not near(a, b) for a in after for b in after if a < b)
    assert all(any(near(k, b) for b in order if b != k) for k in before.keys() - after.keys())
    before, after = kept["decontamination"]
    held = {k for k, r in before.items() if decontaminate.align(decontaminate.hashes(r["text"]), decontaminate.hashes(item))[0] >= 40}
    assert before.keys() - after.keys() == held and held
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in out) == packed([(r["doc_id"], r["text"]) for r in after.values()], 2048)
    for empty in (docs.where("false"),):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, empty, folder).count() == 0
