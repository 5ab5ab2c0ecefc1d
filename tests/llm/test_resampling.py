import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from secretsieve.llm import resampling

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").translate(SMALL))
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in [*w, *(a + " " + b for a, b in zip(w, w[1:]))]]


def brute(rows, target, share=25, least=20):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    big_s, big_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in s}
    out = []
    for doc, text in rows:
        n_words, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((n_words, doc, len(f), weight, score))
    order = sorted((r for r in out if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    drawn = Counter((*r[1:], i) for i, r in enumerate(order[: len(order) * share // 100], 1))
    left = [r[1:] for r in order[len(order) * share // 100 :]] + [r[1:] for r in out if r[0] < least]
    return drawn + Counter((*r, None) for r in left)


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize("share, block_rows, digit_bits", [(25, 4096, 10), (25, 8, 3), (60, 16, 5), (100, 7, 4), (0, 8, 3)])
def test_matches_brute_force(table, corpus, share, block_rows, digit_bits):
    rows = [(doc, text) for doc, text, *_ in corpus] + [(-5, corpus[3][1]), (1 << 62, corpus[4][1]), (None, corpus[5][1]), (7, corpus[7][1])]
    target = [corpus[2][1], None, "", "Passages of a BENCHMARK, with 12 words", corpus[11][1]]
    docs = table(rows).withColumn("score", F.lit("x")).withColumn("pos", F.lit(1)).withColumn("weight", F.lit(0.5))
    result = resampling.resample(docs, docs.sparkSession.createDataFrame([(t,) for t in target], "text string"), share=share, block_rows=block_rows, digit_bits=digit_bits)
    assert got(result) == brute(rows, target, share)


def test_radix_order_of_many_rows(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, rng.randrange(-(1 << 63), 1 << 63), rng.randrange(9)]), rng.randrange(5), rng.randrange(3), rng.randrange(-40, 40)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long").repartition(5)
    ranked = sorted(resampling.radix_ranked(df, block_rows=100, digit_bits=6).collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in ranked] == list(range(len(rows)))
    order = lambda r: (-r[3], r[0] is None, r[0] or 0, r[1])
    assert [order(r) for r in ranked] == sorted(map(order, rows))


def test_slices_and_long_words(monkeypatch):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 50)
    monkeypatch.setattr(resampling, "CACHED_WORDS", 7)
    rng = random.Random(2)
    text = " ".join(rng.choice(["A", "bÇd", "x" * 63, "y" * 64, "z" * 300, "12", "中文", "o'clock"]) for _ in range(400))
    find = resampling.Features(10000)
    parts = list(find(text.encode()))
    n_words, want = features(text)
    assert sum(n for n, _ in parts) == n_words and Counter(np.concatenate([f for _, f in parts]).tolist()) == Counter(want)
    assert list(find(b"")) == [] and list(find(b" .,-")) == []


def test_empty_tables(table, spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(table([]), none).count() == 0
    rows = [(1, "a b"), (2, " ".join(f"w{i}" for i in range(30))), (3, " ".join(f"w{i}" for i in range(25)))]
    assert got(resampling.resample(table(rows), none, share=50)) == brute(rows, [], 50)
