import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from secretsieve.llm import packing
from secretsieve.llm.queries import tokenizer_path


def check(rows, pieces, length, tokenizer):
    coded = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    want = sorted(((d is None, d or 0), tuple(coded(t))) for d, t, *_ in rows)
    got = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["length"] * 4 == len(p["ids"]) and p["length"] > 0
        got.setdefault(p["doc_id"], []).append(p)
    ids = lambda p: tuple(np.frombuffer(p["ids"], dtype="<u4").tolist())
    texts = []
    for doc, parts in got.items():
        # Rows with one id are told apart by where their pieces start.
        parts.sort(key=lambda p: (p["doc_tokens"], p["start"]))
        while parts:
            first = parts.pop(next(i for i, p in enumerate(parts) if p["start"] == 0))
            out = list(ids(first))
            while len(out) < first["doc_tokens"]:
                nxt = next(i for i, p in enumerate(parts) if p["start"] == len(out) and p["doc_tokens"] == first["doc_tokens"])
                out += ids(parts.pop(nxt))
            texts.append(((doc is None, doc or 0), tuple(out)))
    assert sorted(texts) == want
    used = {}
    for p in pieces:
        used.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    padding = 0
    for spans in used.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding / sum(n for spans in used.values() for _, n in spans)


@pytest.mark.parametrize("length", [64, 512])
def test_pieces_cover_every_document(spark, table, corpus, length):
    pieces = [r.asDict() for r in packing.pack(table(corpus), tokenizer_path(), length=length, windows_per_block=4).collect()]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    assert check(corpus, pieces, length, tokenizer) < 0.1


def test_empty_table(table):
    assert packing.pack(table([]), tokenizer_path()).count() == 0


def test_ids_are_the_tokenizers():
    tokenizer, code, rng = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path()), random.Random(2)
    letters = list("aAbZ'.,!?;:<|>endoftxsl0159 \t\n\x0b\x0c\r\x1c\x85\xa0 ́̇İIKſßÉéΣσς中😀-/\x00") + [
        "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'S", "<|startoftext|>"
    ]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for text, ids in zip(texts, code([t.encode() for t in texts])):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_cuts_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        length = 16
        places = np.concatenate(([0], np.cumsum(rng.integers(1, 9, size=rng.integers(1, 30)))))
        fees = rng.integers(0, 40, size=len(places))
        cost, before = packing.cuts(places, fees, length)
        best = [0.0]
        for j in range(1, len(places)):
            options = []
            for i in range(j):
                n = int(places[j] - places[i])
                if n <= length:
                    padding = 0 if n & (n - 1) == 0 else length - n
                    options.append(best[i] + padding + fees[j] + packing.WINDOW_COST * length)
            best.append(min(options))
        assert cost == pytest.approx(best)


def test_query_digest(spark):
    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    rows = __spark_entry__.queries()["op1_packing"](spark, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for r in rows[:200]:
        ids = (tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2])[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())
