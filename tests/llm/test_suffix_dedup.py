import random

import numpy as np
import pytest
import xxhash

from secretsieve.llm import suffix_dedup


def brute(rows, length):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh3_64_intdigest((r[1] or "").encode())))
    seen, out, ends = set(), [], {}
    for doc, text, *_ in order:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - length + 1):
            x = data[i : i + length]
            if x in seen:
                gone[i : i + length] = True
            seen.add(x)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((doc, len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, block, shard", [(100, 1 << 20, 1 << 20), (40, 3000, 2000)])
def test_matches_brute_force(table, corpus, length, block, shard):
    rows = [*corpus, (400, "y" * 300), (401, "ab" * 200 + "y" * 150), (402, "\0" * 260 + "z"), (403, "q\0" * 90)]
    done = suffix_dedup.dedup_substrings(table(rows), length=length, block_bytes=block, shard_bytes=shard).collect()
    got = sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in done], key=str)
    assert got == brute(rows, length)


def hot_gram(n, seed=8):
    """A line in every document, each time with other neighbours, copies of some documents, and nothing else repeated."""
    rng = random.Random(seed)
    text = lambda size: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(size))
    rows = [(i, f"{text(80)}\nThis line of forty bytes is in all of them.\n{text(80)}") for i in range(n)]
    return rows + [(n + k, rows[3 * k][1]) for k in range(n // 10)]


def test_a_hot_gram_is_split(table, monkeypatch, tmp_path):
    rows, settle, folder, limit = hot_gram(400), suffix_dedup.settle, str(tmp_path), 8000

    def weighed(t, length):
        n = sum(int(suffix_dedup.expand(r["sizes"], "<i8").sum()) for r in t.to_pylist())
        with open(f"{folder}/{t.column('shard')[0].as_py()}", "w") as f:
            f.write(str(n))
        return settle(t, length)

    monkeypatch.setattr(suffix_dedup, "settle", weighed)
    done = suffix_dedup.dedup_substrings(table(rows), block_bytes=20_000, shard_bytes=limit).collect()
    got = sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in done], key=str)
    assert got == brute(rows, 100)
    sizes = [int(x.read_text()) for x in tmp_path.iterdir()]
    assert sizes and max(sizes) <= 2 * limit


def test_rows_without_id_are_spread(table):
    """Many rows of one id, or none, make as many blocks as others, and match brute force."""
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(60)}" for _ in range(60))
    shared = " ".join(f"shared{k}" for k in range(30))
    rows = [(rng.choice([None, None, 5, i]), f"{text()} {shared if i % 3 else ''} {text()}") for i in range(120)]
    rows += [(None, rows[0][1])] * 3 + [(5, rows[1][1])] * 2
    done = suffix_dedup.dedup_substrings(table(rows), block_bytes=4000, shard_bytes=4000)
    got = sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in done.collect()], key=str)
    assert got == brute(rows, 100) and sum(r[2] for r in got) > 5000
    nulls = table([(None, f"text number {i}") for i in range(4000)])
    blocks = nulls.select(suffix_dedup.F.pmod(suffix_dedup.F.xxhash64("doc_id", "text"), suffix_dedup.F.lit(16)).alias("b")).distinct().count()
    assert blocks == 16


def test_empty_table(table):
    assert suffix_dedup.dedup_substrings(table([])).count() == 0
    assert suffix_dedup.dedup_substrings(table([(1, "short"), (2, None)])).count() == 2


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abc\0", bytes(range(256))])
def test_two_stage_order(letters):
    rng = random.Random(len(letters))
    for _ in range(25):
        length = rng.choice([32, 40, 100])
        base = bytes(rng.choice(letters) for _ in range(500))
        texts = list({base[a : a + rng.randint(length, length + 50)] for a in [rng.randint(0, 340) for _ in range(8)]})
        sizes = np.array([len(x) for x in texts])
        text = np.frombuffer(b"\0".join(texts) + b"\0" * (length + 16), dtype=np.uint8)
        begin = np.cumsum(sizes + 1) - sizes - 1
        order = suffix_dedup.suffix_order(text, begin, sizes - length + 1, begin + sizes, length)
        wanted = [b + i for b, n in zip(begin.tolist(), (sizes - length + 1).tolist()) for i in range(n)]
        assert sorted(order.tolist()) == wanted
        strings = [text[i : i + length].tobytes() for i in order.tolist()]
        assert strings == sorted(strings)
        shared = suffix_dedup.common_prefixes(text, order, length)
        for k in range(1, len(order)):
            a, b = strings[k - 1], strings[k]
            assert shared[k] == next((i for i in range(length) if a[i] != b[i]), length)


def test_segments_part_every_start():
    rng = np.random.default_rng(4)
    for n in (99, 100, 101, 1000, (1 << 20) + 500):
        data = rng.integers(0, 4, size=n, dtype=np.uint8)
        _, start, count, _ = suffix_dedup.segments(data, 100)
        covered = np.concatenate([np.arange(a, a + k) for a, k in zip(start.tolist(), count.tolist())]) if len(start) else []
        assert np.array_equal(covered, np.arange(max(0, n - 99)))
