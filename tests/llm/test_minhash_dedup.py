import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from secretsieve.llm import minhash_dedup

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = (text or "").translate(SMALL).encode().split()
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def brute(rows, percent=85):
    sets = [plain_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        r = find(i)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return sorted(((doc, len(sets[i]), least.get(find(i)), doc == least.get(find(i))) for i, (doc, *_) in enumerate(rows)), key=str)


def family(rng, n, words=120, edits=(0, 14)):
    """Copies of one text with words changed at random places: likenesses on both sides of the threshold."""
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(*edits)):
            copy[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"split_above": 5}, {"group_shingles": 2000}, {"split_above": 3, "group_shingles": 500}])
def test_matches_brute_force(table, corpus, options):
    rng = random.Random(6)
    rows = list(corpus)
    for k, (n, words) in enumerate([(60, 120), (25, 40), (40, 300), (12, 9)]):
        rows += [(1000 * (k + 1) + i, t, "src0") for i, t in enumerate(family(rng, n, words, (0, max(1, words // 18))))]
    rows += [(None, rows[-1][1]), (None, None), (5000, "Two words"), (5001, "two WORDS"), (5002, "two  words\n"), (5003, "two")]
    docs = table(rows)
    for name in ("node", "checks", "text_hash", "tile", "key", "root", "kept"):
        docs = docs.withColumn(name, F.lit("x"))
    assert got(minhash_dedup.near_duplicates(docs, **options)) == brute(rows)


def test_thresholds(table):
    base = [f"w{i}" for i in range(102)]  # 100 shingles
    rows = [(1, " ".join(base))]
    for k, n in enumerate((80, 86, 87, 88, 95)):  # a prefix of n words has n - 2 of the 100 shingles
        rows.append((10 + k, " ".join(base[:n])))
    found = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(table(rows)).collect()}
    want = {doc: comp for doc, _, comp, _ in brute(rows)}
    assert found == want
    assert got(minhash_dedup.near_duplicates(table(rows), percent=94)) == brute(rows, 94)
    with pytest.raises(ValueError):
        minhash_dedup.near_duplicates(table(rows), percent=100)


def test_checks_keep_what_reaches_the_threshold():
    rng = np.random.default_rng(9)
    least = minhash_dedup.least_matches(85, 1e-6)
    assert list(least) == sorted(least)
    kept = {}
    for likeness in (0.85, 0.4):
        size = 2000
        common = rng.integers(0, 1 << 63, round(2 * size * likeness / (1 + likeness)), dtype=np.uint64)
        checks, keys = [], []
        for _ in range(150):
            a, b = (np.unique(np.concatenate((common, rng.integers(0, 1 << 63, size - len(common), dtype=np.uint64)))) for _ in range(2))
            (ka, ca), (kb, cb) = minhash_dedup.signature(a), minhash_dedup.signature(b)
            checks += [ca, cb]
            keys.append((ka == kb).any())
        import pyarrow as pa

        at = minhash_dedup.survivors(minhash_dedup.checks_of(pa.array(checks)), np.arange(0, 300, 2), np.arange(1, 300, 2), least)
        kept[likeness] = (len(at), sum(keys))
    assert kept[0.85] == (150, 150) and kept[0.4][0] < 15


def test_empty_table(table):
    assert minhash_dedup.near_duplicates(table([])).count() == 0
