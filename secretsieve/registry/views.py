"""The inputs of the registered queries, as projections of the given tables."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import context_window
from ..operators.dataset import add_split

TITLES = [
    "Leaked credential in log output", "Crash with error on start", "Add support for new format",
    "Documentation page is outdated", "How do I run this?", "Weekly sync notes",
]
ANSWERS = ["Secret", ' "Non-sensitive" ', "maybe", "<|im_start|>assistant Secret."]
# Strings in the forms of keys, written so that both engines read them: h and r are a hash and
# random-looking base64 of a customer.
DERIVED = [
    "'AKIA' || upper(substr(h, 1, 16))", "'ghp_' || h || substr(h, 1, 4)", "'glpat-' || substr(r, 1, 20)",
    "'sk_live_' || substr(h, 1, 24)", "'xoxb-' || c_custkey || '-' || substr(h, 1, 12)", "'AC' || h",
    "'npm_' || h || substr(h, 1, 4)", "'shpss_' || h", "'AIza' || substr(h || r, 1, 35)",
    "'SG.' || substr(h, 1, 22) || '.' || substr(h || r, 1, 43)", "'sk-' || h", "'ya29.' || substr(h, 1, 25)",
    "'eyJ' || substr(h, 1, 12) || '.eyJ' || substr(h, 13, 12) || '.' || h",
    "'postgres://u' || c_custkey || ':' || substr(h, 1, 10) || '@h' || c_nationkey || '/d'",
    "'https://hooks.slack.com/services/T' || upper(substr(h, 1, 8)) || '/B' || upper(substr(h, 9, 8)) || '/' || substr(h, 1, 24)",
    "'Bearer ' || r", "'password=' || substr(r, 1, 12)", "'secret: ' || substr(h, 1, 20)", "'token = ' || substr(r, 1, 24)",
    "'-----BEGIN RSA PRIVATE KEY-----'", "'c' || c_custkey || '@' || substr(h, 1, 6) || '.example'", "c_name",
    "substr(r, 1, 24)", "substr(r, 3, 30)", "substr(translate(lower(r), '+/=', ''), 1, 30)", "substr(translate(lower(r), '+/=', ''), 5, 26)",
    "substr(translate(upper(r), '+/=', ''), 1, 22)", "substr(translate(lower(r), '+/=', ''), 1, 20)", "substr(h, 1, 8) || 'xxxx' || substr(h, 9, 8)",
]
ROWS_PER_TASK = 4000  # customers: some seconds of rules on their derived strings
EXTRA_TERMS = ["license", "copyright", "example.com", "token"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def issues_text(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as issues."""
    return documents(spark, folder).select(
        F.col("doc_id").alias("issue_id"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("url"),
        F.col("source").alias("repo"), F.col("text"),
    )


def skip_urls(spark: SparkSession, folder: str) -> DataFrame:
    """A list of known URLs: the documents that were rated toxic."""
    rated = table(spark, folder, "labels").filter("toxic = 1")
    return rated.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("url"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and web pages: prose, markup, links and paths."""
    pages = table(spark, folder, "pages")
    return documents(spark, folder).select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("issue_id"), "text").unionByName(
        pages.select(F.concat(F.lit("page/"), F.col("page_id")).alias("issue_id"), F.col("html").alias("text"))
    )


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda t: F.length(t) >= 12))


def token_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct tokens of at least 12 characters per document, found row by row."""
    return documents(spark, folder).select(F.col("doc_id").alias("issue_id"), F.explode(_tokens(F.col("text"))).alias("candidate_string"))


def _with_contexts(rows: DataFrame, *keep: str) -> DataFrame:
    """Tokens of ``text`` and their windows.  The windows are cut before the
    explode, so no row carries a whole text."""
    pairs = F.transform(
        _tokens(F.col("text")),
        lambda t: F.struct(t.alias("candidate_string"), context_window(F.col("text"), t).alias("context_window")),
    )
    return rows.select(F.col("doc_id").alias("issue_id"), *keep, F.inline(pairs))


def token_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`token_candidates` with their windows."""
    return _with_contexts(documents(spark, folder))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have a label, with their first token as the candidate."""
    rows = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id")
    return rows.select(
        F.col("doc_id").alias("issue_id"), "text", F.regexp_extract("text", r"[^ \t\n\r\f]+", 0).alias("candidate_string"),
        (1 - F.col("quality")).alias("label"), "n_chars", "lang",
    )


def labelled_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token candidates with the label of their document, a row id and a split
    that keeps a document in one part."""
    labels = table(spark, folder, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    # Texts are joined, not their many candidates.
    rows = _with_contexts(documents(spark, folder).join(labels, "doc_id"), "label")
    return add_split(rows.withColumn("id", F.md5(F.concat_ws("|", "issue_id", "candidate_string"))), "issue_id")


def model_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Three rules as models, long form."""
    rows = labelled(spark, folder)
    models = {
        "short": F.col("n_chars") < 300, "long": F.col("n_chars") > 5000, "marked": F.contains(F.col("text"), F.lit("###")),
    }
    guesses = F.array(
        *[F.struct(F.lit(m).alias("model"), guess.cast("int").alias("prediction")) for m, guess in models.items()]
    )
    return rows.select("issue_id", "text", "candidate_string", "label", F.inline(guesses))


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Model answers of four kinds."""
    turns = table(spark, folder, "conversations")
    answer = F.element_at(F.array(*[F.lit(a) for a in ANSWERS]), (F.col("turn") % 4 + 1).cast("int"))
    return turns.select("conv_id", "turn", answer.alias("response"))


def repos(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as repositories."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, folder, "customer").select(
        F.col("c_name").alias("full_name"), F.floor(balance * balance / 100).alias("size_kb"),
        (F.floor(F.abs(balance)) * (key % 3)).alias("stars"), F.col("c_nationkey").cast("long").alias("forks"),
        F.when(key % 10 != 0, F.col("c_mktsegment")).alias("language"),
        (key % 5 == 0).alias("is_fork"), (key % 7 == 0).alias("is_archived"),
    )


def _spread(rows: DataFrame) -> DataFrame:
    """Narrow rows that become much work, dealt to tasks of a fixed number of them.  A file of few bytes, or of one
    row group, is a single task otherwise, however many rows it has."""
    return rows.repartition(ceil(n / ROWS_PER_TASK)) if (n := rows.count()) > ROWS_PER_TASK else rows


def derived_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Strings in the forms of keys, made from every customer."""
    rows = _spread(table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")).withColumn("h", F.md5("c_name"))
    rows = rows.withColumn("r", F.base64(F.unhex(F.concat("h", F.md5(F.concat(F.lit("r"), "c_name"))))))
    return rows.select(F.col("c_custkey").alias("issue_id"), F.explode(F.array(*[F.expr(e) for e in DERIVED])).alias("candidate_string"))


def derived_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The derived strings of a customer as the lines of an issue."""
    rows = _spread(table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")).withColumn("h", F.md5("c_name"))
    rows = rows.withColumn("r", F.base64(F.unhex(F.concat("h", F.md5(F.concat(F.lit("r"), "c_name"))))))
    return rows.select(F.col("c_custkey").alias("issue_id"), F.concat_ws("\n", *[F.expr(e) for e in DERIVED]).alias("text"))


def issues_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as issues of two thirds of the repositories."""
    orders = table(spark, folder, "orders").filter(F.col("o_custkey") % 3 != 0)
    names = table(spark, folder, "customer").select("c_custkey", "c_name")
    key, created = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    title = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (key % 6 + 1).cast("int"))
    return orders.join(names, orders["o_custkey"] == names["c_custkey"]).select(
        key.alias("issue_id"), F.col("c_name").alias("repo_full_name"), title.alias("title"),
        F.array(F.lower("o_orderpriority")).alias("labels"), created.alias("created_at"),
        F.timestamp_add("HOUR", (key % 200).cast("int"), created).alias("updated_at"),
        F.when(F.col("o_orderstatus") == "F", F.timestamp_add("HOUR", (key * 7919 % 5000).cast("int"), created)).alias("closed_at"),
    )


def stream_hits(events: DataFrame) -> DataFrame:
    """Events (a table or a stream) as scan hits, one URL per user."""
    return events.select(
        "event_id", F.concat(F.lit("user/"), F.col("user_id")).alias("url"),
        F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("secret_type"),
    )
