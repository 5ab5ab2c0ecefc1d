from collections import Counter, defaultdict

import numpy as np
import pytest

from secretsieve.llm import line_dedup

SPACES = " \t\n\x0b\x0c\r"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=5):
    key = lambda line: line.translate(SMALL).strip(SPACES)
    docs, keeper = Counter(), defaultdict(lambda: -1)
    for doc, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                docs[k] += 1
                keeper[k] = max(keeper[k], -1 if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = [docs[key(x)] >= min_docs and keeper[key(x)] not in (-1, doc) for x in lines]
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit, asked", [(line_dedup.BROADCAST_BYTES, 1), (0, line_dedup.ASKED_BYTES), (0, 100)])
def test_both_ways_match_brute_force(table, corpus, limit, asked):
    done = line_dedup.dedup_lines(table(corpus), broadcast_bytes=limit, asked_bytes=asked)
    assert set(done.columns) == set(table([]).columns) | {"n_dropped"}
    got = sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in done.collect()], key=str)
    assert got == brute(corpus)
    assert sum(r[2] for r in got) == 19  # 20 documents hold the shared line


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_BYTES, -1])
def test_empty_table_and_no_repeats(table, limit):
    assert line_dedup.dedup_lines(table([]), broadcast_bytes=limit).count() == 0
    assert [r["text"] for r in line_dedup.dedup_lines(table([(1, "a\nb")]), broadcast_bytes=limit).collect()] == ["a\nb"]


def test_questions_are_spread_by_their_size(spark, monkeypatch):
    """However many lines ask a shard, a task gets some of them only."""
    rows = [(i, "\n".join(f"line {k} of many that ask, all of forty characters or more {i % 97}" for k in range(20)), "s", i % 7) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
    seen, make = [], line_dedup.F.sequence
    monkeypatch.setattr(line_dedup.F, "sequence", lambda a, b: seen.append(b) or make(a, b))
    monkeypatch.setattr(line_dedup, "total", lambda frame, value: 400 if "asked" not in frame.columns else 50_000)
    line_dedup.dedup_lines(df, broadcast_bytes=-1, asked_bytes=1000).count()
    assert "49" in str(seen[0])


def test_only_null_ids_keep_the_line(table):
    line = "a line that is long enough to be counted as one"
    rows = [(None, line)] * 6
    assert {r["n_dropped"] for r in line_dedup.dedup_lines(table(rows)).collect()} == {0}


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        keys = rng.integers(0, 1 << 63, size=(n, 2)).astype(np.uint64)
        counts, keepers = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int64) * 3
        shard = line_dedup.Shard.unpack(line_dedup.Shard.build(keys[:, 0], keys[:, 1], counts, keepers).pack())
        slots = shard.probe(keys[:, 0], keys[:, 1])
        assert sorted(slots.tolist()) == list(range(n))
        assert (shard.counts[slots] == counts).all() and (shard.keepers[slots] == keepers).all()
        other = rng.integers(0, 1 << 63, size=(2000, 2)).astype(np.uint64)
        assert (shard.probe(other[:, 0], other[:, 1]) == -1).all()
    same = np.full(3, 9, dtype=np.uint64)  # equal first halves
    second = np.array([1, 2, 3], dtype=np.uint64)
    shard = line_dedup.Shard.build(same, second, np.arange(3, dtype=np.int32), np.arange(3, dtype=np.int64))
    assert sorted(shard.probe(same, second).tolist()) == [0, 1, 2]


def test_key_length_counts_code_points():
    assert line_dedup.keys_of(("é" * 40).encode(), 40)[0] is not None
    assert line_dedup.keys_of(("é" * 39).encode(), 40)[0] is None
    assert line_dedup.keys_of(b"  " + b"A" * 40 + b"\x0b", 40)[0] == b"a" * 40
