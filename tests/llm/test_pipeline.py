from collections import Counter

import numpy as np
import pytest

from secretsieve.llm import packing
from secretsieve.llm.queries import tokenizer_path

FOLDER = "/root/testdata/sf0.001"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    done = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, done[-1], FOLDER).write.parquet(f"{folder}/{name}")
        done.append(spark.read.parquet(f"{folder}/{name}"))
    return done


def test_stages_return_documents(stages):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mixing", "packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes
        assert df.filter("n_chars <> char_length(text)").count() == 0


def test_decisions_take_effect(stages):
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in stages]
    assert ids[0] > ids[1] == ids[2] and ids[2] >= ids[3] >= ids[4] == ids[5]
    counts = [df.count() for df in stages]
    assert counts[1] < counts[0] and counts[4] > len(ids[4])  # epochs repeat rows


def test_sequences_hold_every_token(stages):
    code = packing.Encoder(tokenizer_path())
    texts = [r["text"] for r in stages[4].collect()]
    tokens = sum(len(x) // 4 + 1 for x in code([(t or "").encode() for t in texts]))
    pieces = stages[5].collect()
    assert sum(r["length"] for r in pieces) == tokens
    assert all(len(np.frombuffer(r["ids"], "<u4")) == r["length"] for r in pieces)


def edge_rows(spark, corpus):
    """Null, empty, repeated rows and ids, and columns that bear the operators' names."""
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_dropped double, _in0 string, _size int, fp string, kept int"
    )
    rows = [(d, t, "en", s, len(t or ""), f"x{i}", 0.5, "y", i, "z", i) for i, (d, t, s) in enumerate((*r, "src0")[:3] for r in corpus)]
    return spark.createDataFrame(rows, schema).repartition(3), rows


def test_stages_on_edge_rows(spark, corpus):
    """Every stage but the last keeps columns and types, and the values of the columns that it does not own."""
    import corpus_pipeline

    docs, rows = edge_rows(spark, corpus)
    texts = {r[5]: r for r in rows}
    plain = Counter(line.translate(SMALL).strip(" \t\n\x0b\x0c\r") for _, t, *_ in rows for line in set((t or "").split("\n")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.dtypes == docs.dtypes
        found = out.collect()
        for r in found:
            origin = texts[r["n_lines"]]
            assert (r["doc_id"], r["n_dropped"], r["_in0"], r["_size"], r["fp"], r["kept"]) == (origin[0], 0.5, "y", origin[8], "z", origin[10])
            assert r["n_chars"] == (len(r["text"] or "") if name != "near_duplicates" else origin[4])
        if name == "line_dedup":
            assert len(found) == len(rows)
            gone = {r["n_lines"]: set((texts[r["n_lines"]][1] or "").split("\n")) - set((r["text"] or "").split("\n")) for r in found}
            lost = {x.translate(SMALL).strip(" \t\n\x0b\x0c\r") for lines in gone.values() for x in lines}
            assert lost and all(len(x) >= 40 and plain[x] >= 5 for x in lost)
        if name == "quality_rules":
            assert {r["n_lines"] for r in found} <= set(texts) and all(len((r["text"] or "").split()) >= 10 for r in found)
        if name == "near_duplicates":
            assert len({(r["doc_id"], r["text"]) for r in found}) == len(found) < len(rows)
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), FOLDER).count() == 0


def test_run_gives_the_last_stage(spark, stages):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns == stages[-1].columns and rows.agg({"length": "sum"}).first()[0] == stages[-1].agg({"length": "sum"}).first()[0]


def test_superseded_tables_go(spark, tmp_path):
    import os

    from secretsieve.llm.common import discard, landed

    given = spark.range(5)
    first = landed(given, "first", instead_of=given)
    path = first.folder.removeprefix("file:")
    assert os.path.isdir(path)
    second = landed(first.selectExpr("id + 1 AS id"), "second", instead_of=first)
    assert not os.path.exists(path) and sorted(r["id"] for r in second.collect()) == [1, 2, 3, 4, 5]
    discard(first)
    discard(given)
    assert given.count() == 5
