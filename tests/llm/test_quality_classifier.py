import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from secretsieve.llm import quality_classifier


def made(n=600, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.2
        text = [f"w{rng.randrange(300)}" for _ in range(rng.randint(20, 120))]
        if not good:
            text = [w.upper() + "!!" for w in text]
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["nastyword", "vileword", "badword"]))
        rows.append((i, " ".join(text), f"src{i % 5}"))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, table):
    rows, labels = made()
    known = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.classify(table(rows), known).collect()}
    unseen = [x for x in labels if x[0] % 3 == 0]
    right = sum((got[i]["p_quality"] >= 0.5) == bool(q) and (got[i]["p_toxic"] >= 0.5) == bool(t) for i, q, t in unseen)
    assert right >= 0.97 * len(unseen)
    assert all(got[i]["kept"] == (q == 1 and t == 0) for i, q, t in unseen if (got[i]["p_quality"] >= 0.5) == bool(q) and (got[i]["p_toxic"] >= 0.5) == bool(t))


def test_sparse_sites_are_shrunk_toward_their_parents(spark, table):
    rows, labels = [], []
    for h in range(30):
        good = h % 2 == 0
        for k in range(30):
            i = 100 * h + k
            rows.append((i, "the same plain words in all of the texts", f"h{h:02d}"))
            labels.append((i, int(good if k % 10 else not good), 0))
    rows.append((9999, "the same plain words in all of the texts", "lonely"))
    rows.append((9998, "the same plain words in all of the texts", "h00"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.classify(table(rows), known).collect()}
    assert abs(got[9999]["p_quality"] - 0.5) < 0.05 < 0.3 < got[9998]["p_quality"] - 0.5
    assert 0.5 < got[0]["host_quality"] < 1.0 and got[100]["host_quality"] < 0.5


def test_labels_beyond_the_fitting_limit_count_for_sites(spark, table):
    rows, labels = [], []
    for h in range(10):
        for k in range(40):
            rows.append((100 * h + k, "the same plain words in all of the texts", f"h{h}"))
            labels.append((100 * h + k, int(h % 2 == 0), 0))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.classify(table(rows), known, max_labelled=4).collect()}
    assert all(got[i]["host_quality"] > 0.8 if q else got[i]["host_quality"] < 0.2 for i, q, _ in labels)
    assert all(r["llr_quality"] == 0 for r in got.values())


def test_strength_follows_the_spread_of_sites(spark):
    far = spark.createDataFrame([(0.1, 200), (0.9, 200)] * 5, "m double, n long")
    near = spark.createDataFrame([(0.49, 200), (0.51, 200)] * 5, "m double, n long")
    strength = lambda df: quality_classifier.strength(df, "m", F.lit(0.5), "n")
    assert strength(far) < 5 < 1000 < strength(near)


def plain_strength(groups):
    """groups: (n, mean, parent)"""
    spread = sum(n * (m - p) ** 2 for n, m, p in groups)
    noise = sum(p * (1 - p) for _, _, p in groups)
    weighted = sum(n * p * (1 - p) for n, _, p in groups)
    n = sum(g[0] for g in groups)
    between = max(0.0, spread - noise) / n
    return min(1e6, max(1.0, weighted / n / between - 1)) if between > 0 else 1e6


def plain_classify(rows, labels, target, min_evidence=30.0, min_odds=2.0):
    """Everything but the features in plain Python, for labelled texts without copies; (llr, host, path, p) by id."""
    logit = lambda p: math.log(min(1 - 1e-6, max(1e-6, p)) / (1 - min(1 - 1e-6, max(1e-6, p))))
    chance = lambda x: 1 / (1 + math.exp(-x))
    marked = {i: x[target] for i, *x in labels}
    text = {i: t for i, t, *_ in rows}
    n, ones, seen, hit = len(marked), sum(marked.values()), Counter(), Counter()
    for i, y in marked.items():
        for f in set(quality_classifier.features(text[i].encode()).tolist()):
            seen[f] += 1
            hit[f] += y
    weight = {}
    for f, k in seen.items():
        rate, part = ones / n, lambda x, due: x * math.log(x / due) if x else 0.0
        stat = 2 * (part(hit[f], k * rate) + part(k - hit[f], k * (1 - rate)))
        value = math.log((hit[f] + 0.5) / (ones + 1)) - math.log((k - hit[f] + 0.5) / (n - ones + 1))
        if k >= 4 and stat >= min_evidence and abs(value) >= min_odds:
            weight[f] = value
    llr = {i: max(-20.0, min(20.0, sum(weight.get(f, 0.0) for f in quality_classifier.features(t.encode()).tolist()))) for i, t, *_ in rows}
    own = {i: float(marked[i]) if i in marked else chance(llr[i] + logit(ones / n)) for i, *_ in rows}
    path_of, paths, hosts = {i: (h, "en") for i, _, h in rows}, defaultdict(list), defaultdict(list)
    for i, _, h in rows:
        paths[h, "en"].append(own[i])
        hosts[h].append(own[i])
    mean = sum(own.values()) / len(own)
    k = plain_strength([(len(x), sum(x) / len(x), mean) for x in hosts.values()])
    host = {h: (sum(x) + k * mean) / (len(x) + k) for h, x in hosts.items()}
    k = plain_strength([(len(x), sum(x) / len(x), host[p[0]]) for p, x in paths.items()])
    out = {}
    for i, _, h in rows:
        x = paths[path_of[i]]
        others = (sum(x) - own[i] + k * host[h]) / (len(x) - 1 + k)
        out[i] = (llr[i], host[h], (sum(x) + k * host[h]) / (len(x) + k), chance(llr[i] + logit(others)))
    return out


def test_matches_plain_python(spark, table):
    rows, labels = made(400, seed=7)
    labels = [x for x in labels if x[0] % 4]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.classify(table(rows), known).collect()}
    for t, name in enumerate(("quality", "toxic")):
        want = plain_classify(rows, labels, t)
        assert any(abs(w[0]) > 1 for w in want.values())
        for i, values in want.items():
            assert [got[i][f"{c}_{name}"] for c in ("llr", "host", "path", "p")] == pytest.approx(values, rel=1e-9, abs=1e-9)


def test_only_confirmed_copies_go(spark):
    """A shared least shingle alone costs no document its place in the sample."""
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, shared = words(200), words(30)
    rows = [(1, " ".join(base)), (2, " ".join(base[:190] + words(5) + base[195:])), (3, " ".join(base))]
    rows += [(10 + i, " ".join(words(25) + shared + words(25))) for i in range(60)]  # unlike, with one passage in common
    rows += [(100, None), (101, "")]
    df = spark.createDataFrame(rows, "_id long, _text string")
    left = {r["_id"] for r in quality_classifier.without_copies(df).collect()}
    assert left == {1, 100, *range(10, 70)}


def test_sample_takes_the_least_hashes(spark):
    known = spark.range(5000).select(F.col("id").alias("_id"))
    got = {r["_id"] for r in quality_classifier.labelled_sample(known, 500).collect()}
    want = {r["_id"] for r in known.orderBy(F.xxhash64("_id"), "_id").limit(500).collect()}
    assert got == want and quality_classifier.labelled_sample(known, 6000).count() == 5000


def test_features():
    assert len(quality_classifier.features(b"")) == 0
    a, b = quality_classifier.features(b"Word one"), quality_classifier.features(b"word ONE")
    assert set(a.tolist()) & set(b.tolist()) and set(a.tolist()) != set(b.tolist())
    assert np.array_equal(quality_classifier.features(b"x y"), quality_classifier.features(b"x y"))


def test_edge_rows(spark, table, corpus):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 1), (None, 1, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.classify(table(corpus), labels).collect()
    assert len(rows) == len(corpus) and all(0 < r["p_quality"] < 1 and r["kept"] is not None for r in rows)
    none = quality_classifier.classify(table(corpus), labels.limit(0)).collect()
    assert {round(r["p_quality"], 6) for r in none} == {0.5}
    assert quality_classifier.classify(table([]), labels).count() == 0
    assert quality_classifier.classify(table(corpus), labels, max_labelled=1).count() == len(corpus)
