import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from secretsieve.llm import minhash


@pytest.mark.parametrize("limit", [1 << 18, 3])
def test_blocks_of_hot_and_scattered_ids(table, monkeypatch, limit):
    """One id, or none, fills as many blocks as its bytes need; ids far apart too; each block meets the first document of the next."""
    monkeypatch.setattr(minhash, "MAX_BROADCAST_BLOCKS", limit)
    monkeypatch.setattr(minhash, "RUN", 4)
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    ids = [None] * 60 + [7] * 60 + list(range(100, 160)) + [-(1 << 63), (1 << 63) - 1, 1 << 61]
    rows = [(i, text()) for i in ids]
    docs = table(rows)
    rank = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    dealt, n_blocks = minhash.neighbours(docs, "doc_id", "text", 1000)
    homes = Counter(r["block"] for r in dealt.filter("guest = 0").collect())
    assert n_blocks > 40 and max(homes.values()) < 20
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), rank[r[1]]))
    after = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    got = Counter((r["doc_id"], r["edited_sha256"]) for r in minhash.compare_with_next(docs, block_bytes=1000).collect())
    edited = lambda t: t[: len(t) - len(t) // 3] + after[t][: len(t) // 3]
    assert got == Counter((i, hashlib.sha256(edited(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("block", [1 << 24, 4000])
def test_edited_texts_and_neighbours(table, corpus, block):
    rows = table(corpus)
    rank = {r["t"]: r["h"] for r in rows.select(F.coalesce("text", F.lit("")).alias("t")).distinct().withColumn("h", F.xxhash64("t")).collect()}
    got = minhash.compare_with_next(rows, block_bytes=block).collect()
    order = sorted(corpus, key=lambda r: (r[0] is None, -(r[0] or 0), rank[r[1] or ""]))
    want = []
    for k, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, changed, following = (minhash.sketch(x.encode()) for x in (text, edited, after))
        want.append((
            doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), minhash.packed(own), minhash.packed(changed),
            minhash.likeness(own, changed), minhash.likeness(own, following),
        ))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_likeness_estimates_the_share_of_common_shingles():
    rng = random.Random(1)
    errors = []
    for _ in range(60):
        words = [str(rng.randrange(10**6)) for _ in range(600)]
        keep = rng.randint(0, 600)
        other = words[:keep] + [str(rng.randrange(10**6)) for _ in range(600 - keep)]
        a, b = (" ".join(x).encode() for x in (words, other))
        x, y = (set(minhash.shingle_hashes(t).tolist()) for t in (a, b))
        errors.append(minhash.likeness(minhash.sketch(a), minhash.sketch(b)) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_sparse_texts_are_densified_alike():
    a, b = minhash.sketch(b"one two three"), minhash.sketch(b"ONE  two\tthree ")
    assert np.array_equal(a, b) and minhash.likeness(a, b) == 1.0
    assert minhash.likeness(a, minhash.sketch(b"four five six seven eight nine")) < 0.3
    assert minhash.sketch(b" \n") is None and minhash.likeness(None, None) == 1.0 and minhash.likeness(None, a) == 0.0


def test_packing():
    values = np.random.default_rng(1).integers(0, 16, minhash.BINS).astype(np.uint8)
    text = minhash.packed(values)
    assert len(text) == minhash.BINS * minhash.BITS // 4 and np.array_equal(minhash.unpacked(text), values)
    assert minhash.unpacked("") is None


def test_fingerprints_and_empty_table(table, corpus):
    rows = minhash.fingerprints(table(corpus)).collect()
    texts = {}
    for (doc, text, *_) in corpus:
        texts.setdefault(doc, set()).add(minhash.packed(minhash.sketch((text or "").encode())))
    assert all(r["fingerprint"] in texts[r["doc_id"]] for r in rows) and len(rows) == len(corpus)
    assert minhash.compare_with_next(table([])).count() == 0
    assert minhash.compare_with_next(table([(1, "only one text")])).first()["near_next"] == 1.0
