"""Data set preparation (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset as ds
from ..plans import dataset_build
from . import sql as q
from . import views
from .base import query

_SPLIT = q.SPLIT.format(key="issue_id")


@query("G1_label_counts", q.with_views("labelled", "SELECT count(*) FILTER (label = 0) AS zeros, count(*) FILTER (label = 1) AS ones FROM labelled"))
def label_counts(spark, folder):
    return ds.label_counts(views.labelled(spark, folder))


@query("G2_hash_split", q.with_views("labelled", f"SELECT issue_id, label, {_SPLIT} AS split FROM labelled"))
def hash_split(spark, folder):
    return ds.add_split(views.labelled(spark, folder)).select("issue_id", "label", "split")


@query("G2_exact_split", q.with_views("labelled", f"""SELECT issue_id, label, CASE WHEN no <= n_test THEN 'test'
    WHEN no <= n_test + ceil((n - n_test) * 0.118) THEN 'validation' ELSE 'train' END AS split FROM (
    SELECT *, ceil(n * 0.15) AS n_test FROM (SELECT issue_id, label, count(*) OVER (PARTITION BY label) AS n,
    row_number() OVER (PARTITION BY label ORDER BY {q.HASH.format(key='issue_id', digits=15)}) AS no FROM labelled))"""))
def exact_split(spark, folder):
    return ds.add_exact_split(views.labelled(spark, folder)).select("issue_id", "label", "split")


@query("G3_group_split", q.with_views("labelled_tokens", "SELECT issue_id, split, count(*) AS n_candidates FROM labelled_tokens GROUP BY ALL"))
def group_split(spark, folder):
    return views.labelled_tokens(spark, folder).groupBy("issue_id", "split").agg(F.count(F.lit(1)).alias("n_candidates"))


@query("G4_seeded_shuffle", q.with_views("labelled", "SELECT issue_id, label FROM labelled ORDER BY md5('42:' || issue_id), issue_id"))
def seeded_shuffle(spark, folder):
    return ds.seeded_shuffle(views.labelled(spark, folder).select("issue_id", "label"))


@query("G5_first_rows", q.with_views("labelled", "SELECT issue_id, label FROM labelled ORDER BY issue_id LIMIT 100"))
def first_rows(spark, folder):
    return ds.first_rows(views.labelled(spark, folder).select("issue_id", "label"), 100, [F.col("issue_id")])


@query("G6_class_weights", q.with_views("labelled", """SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight
    FROM (SELECT label, count(*) AS n FROM labelled GROUP BY 1)"""))
def class_weights(spark, folder):
    return ds.class_weights(views.labelled(spark, folder)).withColumn("weight", F.round("weight", 6))


@query("G7_label_distribution", q.with_views("model_predictions", """SELECT kind, split, label, count(*) AS n FROM (
    SELECT 'true' AS kind, split, label FROM parts UNION ALL SELECT model, split, prediction FROM parts) GROUP BY ALL""",
    parts=f"SELECT *, {_SPLIT} AS split FROM model_predictions"))
def label_distribution(spark, folder):
    parts = ds.add_split(views.model_predictions(spark, folder).select("issue_id", "model", "label", "prediction"))
    true = ds.label_distribution(parts).withColumn("kind", F.lit("true"))
    guessed = parts.select(F.col("model").alias("kind"), "split", F.col("prediction").alias("label"))
    return true.unionByName(guessed.groupBy("kind", "split", "label").agg(F.count(F.lit(1)).alias("n")))


_BUILD = "md5(concat_ws('|', candidate_string, text))"


@query("build_dataset", q.with_views("labelled", f"""SELECT issue_id, candidate_string, label, md5(text) AS text_md5, {_SPLIT} AS split
    FROM cleaned WHERE contains(text, candidate_string)""",
    cased=f"SELECT label, text, CASE WHEN n_chars > 5000 THEN upper(candidate_string) ELSE candidate_string END AS candidate_string FROM labelled",
    cleaned=f"""SELECT {_BUILD} AS issue_id, candidate_string, label, CASE WHEN contains(text, candidate_string) THEN text
        ELSE {q.stripped('text', urls=False)} END AS text FROM cased"""))
def build_dataset(spark, folder):
    candidate = F.when(F.col("n_chars") > 5000, F.upper("candidate_string")).otherwise(F.col("candidate_string"))
    rows = views.labelled(spark, folder).select("label", F.col("text").alias("body"), candidate.alias("candidate_string"))
    built = dataset_build.build_dataset([rows.filter("label = 1")], [rows.filter("label = 0")])
    return built.select("issue_id", "candidate_string", "label", F.md5("text").alias("text_md5"), "split")
