import math
import zlib
from collections import Counter

import numpy as np
import pytest

from secretsieve.llm import lm_scoring


@pytest.mark.parametrize("block, items", [(1 << 20, 1 << 20), (2000, 300)])
def test_base_and_model(table, corpus, block, items):
    rows = [r for r in corpus if r[0] is not None] + [(None, "no id", "x")]
    got = lm_scoring.score(table(rows), block_bytes=block, shard_items=items).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    crc = lambda d: zlib.crc32(b"" if d is None else str(d).encode())
    counts, pairs = Counter(), Counter()
    fold_counts, fold_pairs = Counter(), Counter()
    for doc, text, *_ in rows:
        if crc(doc) % 10:
            w = tokens(text)
            counts.update(w)
            pairs.update(zip([b"\n", *w], w))
            if crc(doc) // 10 % 10 == 0:
                fold_counts.update(w)
                fold_pairs.update(zip([b"\n", *w], w))
    n, v = sum(counts.values()), len(counts)
    # The histogram in plain Python, then the same learning step.
    rest, rest_pairs = counts - fold_counts, pairs - fold_pairs
    n_rest, v_rest = sum(rest.values()), len(rest)
    bucket = lambda c: 0 if c == 0 else 1 + int(math.log2(c))
    ratio = lambda p: lm_scoring.NONE if p == 0 else int(np.round(lm_scoring.STEP * np.log2(p * (v_rest + 1))))
    cells = Counter()
    for (a, b), k in fold_pairs.items():
        cells[bucket(rest[a]), ratio(rest_pairs[a, b] / max(1, rest[a])), ratio(rest[b] / n_rest)] += k
    weights = lm_scoring.learn_weights(np.array([(*c, k) for c, k in cells.items()]))
    want = []
    for doc, text, *_ in rows:
        w = tokens(text)
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = 0.0
        for a, b in zip([b"\n", *w], w):
            l0, l1, l2 = weights[bucket(counts[a])]
            score += math.log10(l0 / (v + 1) + l1 * counts[b] / n + l2 * pairs[a, b] / max(1, counts[a]))
        want.append((doc, crc(doc) % 10 == 0, len(w), sum(counts[x] > 0 for x in w), n, round(base, 4), round(score, 4)))
    have = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_weights_are_distributions_and_explain_held_out_counts():
    rows = np.array([(5, 40, 16, 50), (5, lm_scoring.NONE, 16, 10), (9, 24, 8, 70), (0, lm_scoring.NONE, 8, 5), (9, lm_scoring.NONE, lm_scoring.NONE, 1)])
    weights = lm_scoring.learn_weights(rows)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[:, :2] > 0).all() and weights[0, 2] == 0
    ratio = lambda x: np.where(x == lm_scoring.NONE, 0, np.exp2(x / lm_scoring.STEP))
    fit = lambda w: (rows[:, 3] * np.log(w[rows[:, 0], 0] + w[rows[:, 0], 1] * ratio(rows[:, 2]) + w[rows[:, 0], 2] * ratio(rows[:, 1]))).sum()
    assert fit(weights) > fit(lm_scoring.learn_weights(rows, rounds=1)) > fit(np.full_like(weights, 1 / 3))


def test_packing_of_numbers():
    x = np.array([0, 1, 5, 1 << 40], dtype="<u8")
    assert np.array_equal(lm_scoring.expand(lm_scoring.squeeze(x), "<u8"), x)


def test_empty_table_and_nothing_to_learn(table):
    assert lm_scoring.score(table([])).count() == 0
    only = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows = lm_scoring.score(table(only)).collect()
    assert {r["train_tokens"] for r in rows} == {0} and all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in rows)


def test_model_beats_unigrams_on_held_out_text(spark):
    rows = lm_scoring.score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
