import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from secretsieve.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.sampled_from([5, 2, 1])), min_size=1, max_size=12), st.floats(0.1, 2.5))
def test_water_filling(sources, share):
    sizes, weights = zip(*sources)
    budget = share * sum(sizes)
    targets = mixing.water_fill(sizes, weights, budget, 3)
    assert sum(targets) == pytest.approx(min(budget, 3 * sum(sizes)))
    level = [t / w for t, w, n in zip(targets, weights, sizes) if t < 3 * n - 1e-6]
    assert not level or max(level) - min(level) <= 1e-6 * (1 + max(level))
    assert all(t <= 3 * n + 1e-6 for t, n in zip(targets, sizes))
    # A clamped source would get no less at the common level.
    assert all(w * max(level, default=0) >= t - 1e-6 for t, w, n in zip(targets, weights, sizes) if t >= 3 * n - 1e-6)


def test_many_sources_take_linear_time():
    import time

    rng = random.Random(1)
    sizes = [rng.randrange(1, 10**6) for _ in range(200_000)]
    start = time.perf_counter()
    targets = mixing.water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], sum(sizes), 3)
    assert time.perf_counter() - start < 5 and sum(targets) == pytest.approx(sum(sizes))


def test_sources_beyond_the_broadcast_stay_a_table(table):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(0, 30)), rng.choice([None, *[f"s{k}" for k in range(40)]])) for i in range(400)]
    few, many = (mixing.plan(table(rows), max_sources=n) for n in (10_000, 7))
    pick = lambda df: sorted(((r["doc_id"], r["taken"], r["whole"], round(r["target"], 6)) for r in df.collect()))
    assert pick(few) == pick(many)
    count = lambda n: sorted((r["doc_id"], r["text"]) for r in mixing.mix(table(rows), max_sources=n).collect())
    assert count(10_000) == count(7)


def test_plan(table, corpus):
    rows = mixing.plan(table(corpus)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, size(t)) for d, t, *_ in corpus)
    sources = sorted({s for *_, s in corpus if s is not None}) + [None]
    sizes = [sum(size(t) for _, t, s in corpus if s == x) for x in sources]
    targets = mixing.water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))], sum(sizes), 3)
    for s, n, t in zip(sources, sizes, targets):
        mine = [r for r in rows if r["source"] == s]
        assert {(r["source_size"], r["target"]) for r in mine} == {(n, t)}
        assert sum(r["taken"] for r in mine) == round(t)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
        assert sum(0 < r["part"] < r["size"] for r in mine) <= 1
    again = mixing.plan(table(random.Random(3).sample(corpus, len(corpus)))).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_mix_materialises_the_plan(table, corpus):
    docs = table(corpus)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = Counter()
    for r in mixed.collect():
        taken[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    want = Counter()
    for r in mixing.plan(docs).collect():
        want[r["doc_id"]] += r["taken"]
    assert +taken == +want
    texts = {}
    for d, t, *_ in corpus:
        texts.setdefault(d, []).append(t or "")
    assert all(any(t.startswith(r["text"] or "") for t in texts[r["doc_id"]]) for r in mixed.collect())


def test_words_and_prefixes(spark):
    from pyspark.sql import functions as F

    texts = ["", "  a", "a  b\n\tc ", "é\xa0x y", "\x1cq w", "word " * 20000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", mixing.n_words(F.col("t")).alias("n"), mixing.first_words(F.col("t"), F.lit(2)).alias("two")).collect()
    for r in rows:
        assert r["n"] == len(WORD.findall(r["t"]))
        assert r["t"].startswith(r["two"]) and len(WORD.findall(r["two"])) == min(2, r["n"])


def test_empty_table_and_no_words(table):
    assert mixing.plan(table([])).count() == 0 and mixing.mix(table([])).count() == 0
    assert [r["taken"] for r in mixing.plan(table([(1, None), (2, " ")])).collect()] == [0, 0]
