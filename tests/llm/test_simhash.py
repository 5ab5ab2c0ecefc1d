import random

import numpy as np
import pytest
import xxhash

from secretsieve.llm import simhash
from secretsieve.llm.components import components

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, k):
    w = (text or "").translate(SMALL).encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[i : i + k]), seed=42).intdigest() for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, max_bits):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= max_bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("max_bits", [0, 2, 5])
def test_groups_match_brute_force(table, corpus, max_bits):
    rows = [r for r in corpus if r[0] is not None]
    got = simhash.near_duplicates(table(rows), max_bits=max_bits).collect()
    fps = [plain_fingerprint(t, 3) for _, t, *_ in rows]
    roots = brute_components(fps, max_bits)
    least = {}
    for (doc, *_), r in zip(rows, roots):
        least[r] = min(least.get(r, doc), doc)
    want = sorted((doc, format(f, "016x"), least[r]) for (doc, *_), f, r in zip(rows, fps, roots))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


@pytest.mark.parametrize("max_bits, split", [(1, 3), (2, 10**9), (2, 5), (3, 4)])
def test_links_lose_nothing(spark, max_bits, split):
    rng = random.Random(max_bits * 7 + split)
    values = {rng.getrandbits(64) for _ in range(60)}
    for center in list(values)[:6]:  # chains and balls of near values
        x = center
        for _ in range(150):
            x = rng.choice([x, center]) ^ (1 << rng.randrange(64))
            values.add(x)
    values = sorted(simhash.signed(x) for x in values)
    nodes = spark.createDataFrame([(x,) for x in values], "fp long").repartition(3)
    found = simhash.links(nodes, max_bits, split)
    pairs = found.collect()
    assert all(((r["u"] ^ r["v"]) & (1 << 64) - 1).bit_count() <= 64 for r in pairs)
    got = {r["node"]: r["root"] for r in components(found).collect()}
    roots = brute_components([x & (1 << 64) - 1 for x in values], max_bits)
    assert [got.get(x, x) for x in values] == [values[r] for r in roots]


def test_long_runs_look_up_neighbours():
    rng = np.random.default_rng(2)
    base = np.uint64(rng.integers(1 << 62))
    fp = np.unique(base ^ (np.uint64(1) << rng.integers(40, 64, 700).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(40, 64, 700).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(40, 64, 700).astype(np.uint64)))
    assert len(fp) > simhash.SHORT_RUN
    masks = simhash.flips(list(range(40, 64)), 2)
    a, b = simhash.run_links(np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64), fp, {0: masks}, 2)
    got = {frozenset(x) for x in zip(a.tolist(), b.tolist())}
    distance = np.bitwise_count(fp[:, None] ^ fp[None, :])
    assert got == {frozenset((i, j)) for i, j in zip(*np.nonzero(distance <= 2)) if i < j}


def test_pigeonring_never_drops_a_near_pair():
    rng = np.random.default_rng(3)
    for bits in (1, 2, 4):
        xor = np.zeros(5000, dtype=np.uint64)
        for _ in range(bits):
            xor ^= np.uint64(1) << rng.integers(0, 64, 5000).astype(np.uint64)
        assert simhash.pigeonring(xor, bits).all()


def test_keep_one_keeps_columns_and_one_row_per_group(table, corpus):
    docs = table(corpus)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 7 in ids and not set(range(100, 108)) & set(ids) and 300 in ids and 301 not in ids


def test_keep_one_keeps_a_row_of_every_component(table):
    rng = random.Random(11)
    text = lambda: " ".join(f"{rng.randrange(10**6)}" for _ in range(60))
    alone, other, third, copied, left, right, both = (text() for _ in range(7))
    rows = [(None, alone), (None, other), (None, third), (None, third), (None, copied), (5, copied), (9, left), (9, right), (9, right), (20, both), (21, both)]
    kept = simhash.keep_one(table(rows)).collect()
    got = sorted(((r["doc_id"], r["text"]) for r in kept), key=str)
    assert got == sorted([(None, alone), (None, other), (None, third), (5, copied), (9, left), (9, right), (20, both)], key=str)


def test_empty_table(table):
    assert simhash.near_duplicates(table([])).count() == 0
    assert simhash.keep_one(table([])).count() == 0
