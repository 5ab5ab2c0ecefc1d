"""Sources and sinks (A) and relational work (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.terms import broad_terms, strict_terms
from ..operators import extract, relational
from ..plans import issue_scan
from ..schemas import ISSUE_META, LABELLED, REPO
from ..session import shared_folder
from ..sources import readers, sinks
from . import sql as q
from . import views
from .base import query

LABELLED_ROW = "issue_id, text, candidate_string, label"


# ------------------------------------------------------------------ A: sources
def _labelled_rows(spark, folder):
    return views.labelled(spark, folder).select(
        F.col("issue_id").cast("string").alias("issue_id"), "text", "candidate_string", F.col("label").cast("int").alias("label"))


_LABELLED_TEXT = "SELECT issue_id::VARCHAR AS issue_id, md5(text) AS text_md5, candidate_string, label FROM labelled"


def _hashed(df):
    return df.select("issue_id", F.md5("text").alias("text_md5"), "candidate_string", "label")


@query("A1_csv_dataset", q.with_views("labelled", _LABELLED_TEXT))
def csv_dataset(spark, folder):
    # As other programs write it: an index first, another order, another case.
    path = shared_folder(spark, "labelled")
    rows = _labelled_rows(spark, folder).withColumn("", F.col("issue_id")).withColumnRenamed("issue_id", "Issue_id")
    sinks.append_csv(rows.select("", "Issue_id", "label", "text", "candidate_string"), path)
    return _hashed(readers.read_csv_dataset(spark, path, LABELLED))


@query("A2_read_by_extension", q.with_views("labelled", " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, * FROM ({_LABELLED_TEXT})" for kind in ("csv", "json", "parquet"))))
def read_by_extension(spark, folder):
    base, rows = shared_folder(spark, "formats"), _labelled_rows(spark, folder)
    sinks.append_csv(rows, f"{base}/rows.csv")
    rows.write.json(f"{base}/rows.json")
    rows.write.parquet(f"{base}/rows.parquet")
    parts = [
        _hashed(readers.read_dataset(spark, f"{base}/rows.{kind}", LABELLED)).withColumn("kind", F.lit(kind))
        for kind in ("csv", "json", "parquet")
    ]
    return relational.union_parts(*parts)


# Brands and types of parts make a catalog with missing names and empty patterns.
_CATALOG = r"""SELECT p_brand || '/' || p_type AS pattern_id,
    CASE WHEN p_type = 'PROMO' THEN NULL ELSE ' ' || p_type || ' ' END AS secret_type,
    CASE WHEN p_type = 'SMALL' THEN NULL WHEN p_type = 'LARGE' THEN '  '
         ELSE ' ' || replace(p_brand, '#', '[#]') || '-[0-9]{4} ' END AS pattern
    FROM (SELECT DISTINCT p_brand, p_type FROM part)"""


def _catalog(spark, folder):
    kind = F.col("p_type")
    return views.table(spark, folder, "part").select("p_brand", "p_type").distinct().select(
        F.concat_ws("/", "p_brand", "p_type").alias("pattern_id"),
        F.when(kind != "PROMO", F.concat(F.lit(" "), kind, F.lit(" "))).alias("secret_type"),
        F.when(kind == "SMALL", F.lit(None)).when(kind == "LARGE", "  ").otherwise(
            F.concat(F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit("[#]")), F.lit("-[0-9]{4} "))).alias("pattern"))


@query("A3_pattern_catalog", q.with_views("", """SELECT (row_number() OVER (ORDER BY place))::INT AS pattern_rank,
    coalesce(nullif(trim(secret_type), ''), 'Pattern_' || place) AS secret_type, trim(pattern) AS pattern
    FROM (SELECT *, row_number() OVER (ORDER BY pattern_id) AS place FROM catalog) WHERE trim(coalesce(pattern, '')) <> ''""",
    catalog=_CATALOG))
def pattern_catalog(spark, folder):
    return readers.clean_catalog(_catalog(spark, folder))


# Rules in another dialect: words that end like the name of a region.
_RULE = "SELECT r_name AS secret_type, '(?P<the_word>[a-z]+' || lower(substr(r_name, 1, 2)) || ')[.,]\\s' AS pattern, r_regionkey FROM region"


@query("A3_catalog_scan", q.with_views("", """SELECT d.doc_id AS issue_id, r.secret_type, regexp_extract(d.text, '(?i)' || r.pattern, 0) AS candidate_string
    FROM documents d, rules r WHERE regexp_matches(d.text, '(?i)' || r.pattern)
    QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY r.r_regionkey) = 1""",
    rules="SELECT secret_type, replace(pattern, '(?P<the_word>', '(') AS pattern, r_regionkey FROM (" + _RULE + ")"))
def catalog_scan(spark, folder):
    """A catalog file, its rules, and a scan with them."""
    path = shared_folder(spark, "catalog")
    pattern = F.concat(F.lit("(?P<the_word>[a-z]+"), F.lower(F.substring("r_name", 1, 2)), F.lit(r")[.,]\s"))
    rules = views.table(spark, folder, "region").select(
        F.format_string("P%03d", "r_regionkey").alias("Pattern_ID"), F.col("r_name").alias("Secret Type"), pattern.alias("Regular Expression"), F.lit("made").alias("Source"))
    broken = spark.createDataFrame([("P000a", "Broken", "(", "made"), ("P000b", "Empty", "  ", "made")], rules.schema)
    sinks.append_csv(rules.unionByName(broken), path)
    issues = views.issues_text(spark, folder)
    hits = extract.first_match_scan(issues, readers.load_rules(readers.read_catalog(spark, path)), body="text")
    return hits.select("issue_id", "secret_type", "candidate_string")


@query("A4_url_list", q.with_views("", "SELECT DISTINCT url FROM pages"))
def url_list(spark, folder):
    path = shared_folder(spark, "urls")
    pages = views.table(spark, folder, "pages")
    # Twice, padded, with blank lines in between.
    lines = F.explode(F.array(F.col("url"), F.concat(F.lit(" \t"), "url", F.lit("\u00a0")), F.lit("   "), F.lit("")))
    pages.select(lines.alias("value")).write.text(path)
    return readers.read_url_list(spark, path)


_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


@query("A5_metadata", q.with_views("repos issues_meta", """SELECT 'issue' AS kind, repo_full_name AS name, count(*) AS n,
    count(closed_at) AS n_closed, max(epoch(created_at))::BIGINT AS newest FROM issues_meta GROUP BY ALL
    UNION ALL SELECT 'repo', full_name, sum(stars)::BIGINT, 0, sum(size_kb)::BIGINT FROM repos GROUP BY ALL"""))
def metadata(spark, folder):
    base = shared_folder(spark, "metadata")
    stamp = lambda c: F.date_format(c, _ISO).alias(c)
    issues = views.issues_meta(spark, folder).select(
        "repo_full_name", "title", "labels", stamp("created_at"), stamp("updated_at"),
        # A stamp that does not parse must end as NULL.
        F.coalesce(F.date_format("closed_at", _ISO), F.lit("still open")).alias("closed_at"))
    issues.select(*ISSUE_META.names).write.json(f"{base}/issues")
    # As other programs write it: files of one array, the size under another name.
    rows = views.repos(spark, folder).withColumnRenamed("size_kb", "size")
    array = F.to_json(F.collect_list(F.struct(*[c if c != "size_kb" else "size" for c in REPO.names])))
    rows.groupBy((F.col("forks") % 5).alias("part")).agg(array.alias("value")).write.partitionBy("part").text(f"{base}/repos")
    read = readers.read_issue_metadata(spark, f"{base}/issues")
    none = readers.read_repos(spark, f"{base}/missing")
    repos = readers.read_repos(spark, f"{base}/repos").unionByName(none)
    return read.groupBy(F.lit("issue").alias("kind"), F.col("repo_full_name").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.count("closed_at").alias("n_closed"),
        F.max(F.unix_timestamp("created_at")).alias("newest"),
    ).unionByName(repos.groupBy(F.lit("repo").alias("kind"), F.col("full_name").alias("name")).agg(
        F.sum("stars").alias("n"), F.lit(0).cast("long").alias("n_closed"), F.sum("size_kb").alias("newest")))


# Raw issues: documents with label structs; every seventh is a pull request and
# every fifth has no body.
_RAW = """SELECT doc_id AS number, CASE WHEN doc_id % 5 <> 0 THEN text END AS body,
    'https://host/' || lang || '/' || source || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '' END AS repository_url,
    CASE WHEN doc_id % 3 = 0 THEN [] ELSE [{'name': lang}, {'name': source}] END AS labels,
    CASE WHEN doc_id % 7 = 0 THEN {'url': 'pr/' || doc_id} END AS pull_request FROM documents"""


def _raw_issues(spark, folder):
    key = F.col("doc_id")
    label = lambda c: F.struct(F.col(c).alias("name"))
    some = F.array(label("lang"), label("source"))
    return views.table(spark, folder, "documents").select(
        key.alias("number"), F.when(key % 5 != 0, F.col("text")).alias("body"),
        F.concat(F.lit("https://host/"), "lang", F.lit("/"), "source", F.when(key % 2 == 0, "/").otherwise("")).alias("repository_url"),
        F.when(key % 3 == 0, F.filter(some, lambda x: F.lit(False))).otherwise(some).alias("labels"),
        F.when(key % 7 == 0, F.struct(F.concat(F.lit("pr/"), key).alias("url"))).alias("pull_request"))


@query("A6_flatten_issues", q.with_views("", """SELECT number, md5(coalesce(body, '')) AS body_md5,
    array_to_string(list_transform(labels, lambda x: x.name), ', ') AS labels,
    string_split(rtrim(repository_url, '/'), '/')[-2] AS owner, string_split(rtrim(repository_url, '/'), '/')[-1] AS name FROM raw""",
    raw=_RAW))
def flatten(spark, folder):
    return relational.flatten_issues(_raw_issues(spark, folder)).select(
        "number", F.md5("body").alias("body_md5"), "labels", "owner", "name")


@query("A7_only_issues", q.with_views("", "SELECT number FROM raw WHERE pull_request IS NULL", raw=_RAW))
def only_issues(spark, folder):
    return relational.only_issues(_raw_issues(spark, folder)).select("number")


@query("A8_sinks", q.with_views("model_predictions", """SELECT error_type, model, count(*) AS n, sum(length(candidate_string))::BIGINT AS chars
    FROM (SELECT *, CASE WHEN label = prediction THEN 'Correct' WHEN label = 0 THEN 'False Positive' ELSE 'False Negative' END AS error_type
    FROM model_predictions) GROUP BY ALL"""))
def result_sinks(spark, folder):
    from .evaluation import tagged

    path = shared_folder(spark, "predictions")
    sinks.write_by_error(tagged(spark, folder).select("error_type", "model", "candidate_string", "candidate_length"), path)
    return spark.read.parquet(path).groupBy("error_type", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("candidate_length").alias("chars"))


@query("A8_repeated_run", q.with_views("model_predictions", """SELECT run_id, model, count(*) AS n, sum(label)::BIGINT AS positives
    FROM model_predictions, (VALUES ('first'), ('second')) r(run_id) GROUP BY ALL"""))
def repeated_run(spark, folder):
    """Two runs, one of them repeated: each leaves one copy."""
    path, rows = shared_folder(spark, "runs"), views.model_predictions(spark, folder).select("model", "issue_id", "label")
    for run_id in ("first", "second", "first"):
        sinks.append_hits(rows, path, run_id)
    return spark.read.parquet(path).groupBy("run_id", "model").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("positives"))


@query("A9_resume", q.with_views("issues_text", "SELECT issue_id FROM issues_text WHERE issue_id NOT IN (SELECT doc_id FROM labels)"))
def resume(spark, folder):
    # The rated documents are the output so far.
    path = shared_folder(spark, "done")
    views.labelled(spark, folder).select("issue_id").write.parquet(path)
    return relational.exclude_known(views.issues_text(spark, folder), spark.read.parquet(path), ["issue_id"]).select("issue_id")


# ------------------------------------------------------------------- B: cleaning
_DIRTY = """SELECT issue_id, CASE WHEN issue_id % 11 <> 0 THEN text END AS text,
    CASE WHEN issue_id % 13 <> 0 THEN candidate_string END AS candidate_string,
    CASE issue_id % 17 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE label::DOUBLE END AS label
    FROM labelled"""


@query("B1_clean_labelled", q.with_views("labelled", """SELECT issue_id, md5(text) AS text_md5, candidate_string, label::INT AS label
    FROM dirty WHERE text IS NOT NULL AND candidate_string IS NOT NULL AND NOT isnan(label) AND NOT isinf(label)""", dirty=_DIRTY))
def clean_labelled(spark, folder):
    key, label = F.col("issue_id"), F.col("label").cast("double")
    dirty = views.labelled(spark, folder).select(
        "issue_id", F.when(key % 11 != 0, F.col("text")).alias("text"),
        F.when(key % 13 != 0, F.col("candidate_string")).alias("candidate_string"),
        F.when(key % 17 == 0, float("nan")).when(key % 17 == 1, float("inf")).when(key % 17 == 2, None).otherwise(label).alias("label"))
    return _hashed(relational.clean_labelled(dirty))


@query("B2_project_rename", q.with_views("labelled", "SELECT candidate_string, md5(text) AS text_md5 FROM labelled"))
def project_rename(spark, folder):
    bodies = views.labelled(spark, folder).withColumnRenamed("text", "body")
    return relational.as_text_table(bodies).select("candidate_string", F.md5("text").alias("text_md5"))


_PARTS = ["label = 1", "label = 0", "n_chars > 5000"]


@query("B3_union_parts", q.with_views("labelled", " UNION ALL ".join(f"SELECT issue_id, candidate_string, label FROM labelled WHERE {p}" for p in _PARTS)))
def union_parts(spark, folder):
    # The parts overlap and differ in column order.
    parts = [views.labelled(spark, folder).filter(p).select("issue_id", "candidate_string", "label") for p in _PARTS]
    return relational.union_parts(parts[0], parts[1].select("label", "candidate_string", "issue_id"), parts[2])


@query("B4_label_and_id", q.with_views(
    "labelled", "SELECT candidate_string, 1 AS label, md5(concat_ws('|', candidate_string, text)) AS issue_id FROM labelled"))
def label_and_id(spark, folder):
    rows = views.labelled(spark, folder).select("candidate_string", "text")
    return relational.with_label_and_id(rows, 1, ["candidate_string", "text"]).drop("text")


@query("B5_exclude_known", q.with_views("issues_text skip_urls", "SELECT issue_id, url FROM issues_text WHERE url NOT IN (SELECT url FROM skip_urls)"))
def exclude_known(spark, folder):
    issues = views.issues_text(spark, folder)
    return relational.exclude_known(issues, views.skip_urls(spark, folder), ["url"]).select("issue_id", "url")


@query("B6_first_per_url", q.with_views("stream_hits", "SELECT url, min(event_id) AS event_id, arg_min(secret_type, event_id) AS secret_type FROM stream_hits GROUP BY 1"))
def first_per_url(spark, folder):
    hits = views.stream_hits(views.table(spark, folder, "events"))
    return relational.first_per_url(hits, [F.col("event_id")]).select("url", "event_id", "secret_type")


@query("B7_first_pattern", q.with_views("texts", """SELECT issue_id, candidate_string, min(pattern_rank) AS pattern_rank,
    arg_min(secret_type, pattern_rank) AS secret_type FROM matches GROUP BY 1, 2""", matches=q.ALL_MATCHES))
def first_pattern(spark, folder):
    return relational.first_pattern_per_candidate(extract.all_matches(views.texts(spark, folder), body="text"))


@query("B8_recent_issues", q.with_views("issues_meta", """SELECT issue_id, repo_full_name, rank::INT AS recency FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_full_name ORDER BY created_at DESC, issue_id) AS rank
    FROM issues_meta) WHERE rank <= 20"""))
def recent_issues(spark, folder):
    issues = views.issues_meta(spark, folder)
    return relational.recent_issues(issues, repo="repo_full_name").select("issue_id", "repo_full_name", "recency")


@query("B9_cap_hits", q.with_views("texts", f"""SELECT issue_id, pattern_rank, secret_type FROM flags
    QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY pattern_rank) <= 2""", flags=q.FLAGS))
def cap_hits(spark, folder):
    flags = extract.pattern_flags(views.texts(spark, folder), body="text")
    return relational.cap_hits(flags, per_issue=2).select("issue_id", "pattern_rank", "secret_type")


@query("B10_join_issues", q.with_views("texts", """SELECT issue_id, pattern_rank, candidate_string, length(text)::INT AS n_chars
    FROM matches JOIN texts USING (issue_id)""", matches=q.ALL_MATCHES))
def join_issues(spark, folder):
    issues = views.texts(spark, folder)
    joined = relational.join_issues(extract.all_matches(issues, body="text"), issues.select("issue_id", F.length("text").alias("n_chars")))
    return joined.select("issue_id", "pattern_rank", "candidate_string", "n_chars")


_TERMS = list(dict.fromkeys([*broad_terms(), *views.EXTRA_TERMS]))
_ANY_TERM = f"(SELECT bool_or(contains(lower(text), term)) FROM (SELECT unnest({q.listed(_TERMS)}) AS term))"
_MENTIONS = f"SELECT issue_id, term FROM texts, (SELECT unnest({q.listed(_TERMS)}) AS term) WHERE contains(lower(text), term)"


@query("B11_keyword_filter", q.with_views("texts", "SELECT DISTINCT issue_id FROM mentions", mentions=_MENTIONS))
def keyword_filter(spark, folder):
    return relational.keyword_filter(views.texts(spark, folder), _TERMS, "text").select("issue_id")


_STRICT = strict_terms()


# The given texts hold none of the strict terms, so derived ones are searched too.
_SEARCHED = "SELECT 'text/' || issue_id AS issue_id, text FROM texts UNION ALL SELECT 'derived/' || issue_id, text FROM derived_texts"


@query("B11_keyword_filter_strict", q.with_views(
    "texts derived_texts", f"SELECT DISTINCT issue_id FROM searched, (SELECT unnest({q.listed(_STRICT)}) AS term) WHERE contains(lower(text), term)", searched=_SEARCHED))
def keyword_filter_strict(spark, folder):
    given, derived = views.texts(spark, folder), views.derived_texts(spark, folder)
    rows = [df.select(F.concat(F.lit(f"{name}/"), "issue_id").alias("issue_id"), "text") for name, df in (("text", given), ("derived", derived))]
    return relational.keyword_filter(rows[0].unionByName(rows[1]), _STRICT, "text").select("issue_id")


@query("B11_strict_on_derived", q.with_views(
    "derived_texts", f"SELECT issue_id, term FROM derived_texts, (SELECT unnest({q.listed(_STRICT)}) AS term) WHERE contains(lower(text), term)"))
def strict_on_derived(spark, folder):
    texts = relational.keyword_filter(views.derived_texts(spark, folder), _STRICT, "text")
    return relational.matched_terms(texts, _STRICT, "text").select("issue_id", "term")


@query("B12_keyword_yield", q.with_views(
    "texts", "SELECT term, count(*) AS n_issues, count(h.issue_id) AS n_hits FROM mentions m LEFT JOIN hits h USING (issue_id) GROUP BY 1",
    mentions=_MENTIONS, hits=f"SELECT issue_id FROM texts WHERE {q.first_match('text', 'rank')} IS NOT NULL"))
def keyword_yield(spark, folder):
    return issue_scan.keyword_yield(views.texts(spark, folder), _TERMS, body="text")


@query("B13_flagged", q.with_views("model_predictions", "SELECT issue_id, md5(text) AS text_md5, candidate_string FROM model_predictions WHERE prediction = 1"))
def flagged(spark, folder):
    kept = relational.flagged(views.model_predictions(spark, folder))
    return kept.select("issue_id", F.md5("text").alias("text_md5"), "candidate_string")


# --------------------------------------------------------------- whole scan jobs
_SCAN_HITS = f"""SELECT issue_id, url, {q.first_match('text', 'type')} AS secret_type, {q.first_match('text', 'match')} AS candidate_string
    FROM issues_text WHERE url NOT IN (SELECT url FROM skip_urls) AND {_ANY_TERM}"""


@query("scan_issues", q.with_views("issues_text skip_urls", "SELECT * FROM hits WHERE secret_type IS NOT NULL", hits=_SCAN_HITS))
def scan_issues(spark, folder):
    issues = views.issues_text(spark, folder).withColumnRenamed("text", "body")
    hits = issue_scan.scan_issues(issues, views.skip_urls(spark, folder), terms=_TERMS)
    return hits.select("issue_id", "url", "secret_type", "candidate_string")


@query("scan_recent_issues", q.with_views(
    "issues_text skip_urls", "SELECT issue_id, pattern_rank, secret_type FROM flags",
    open_issues="""SELECT *, epoch_ms(issue_id * 1000) AS created_at FROM issues_text
        WHERE issue_id % 7 <> 0 AND url NOT IN (SELECT url FROM skip_urls)""",
    texts="SELECT * FROM open_issues QUALIFY row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, issue_id) <= 20",
    flags=q.FLAGS))
def scan_recent_issues(spark, folder):
    issues = views.issues_text(spark, folder).withColumnRenamed("text", "body").withColumns({
        "created_at": F.timestamp_seconds("issue_id"), "pull_request": F.when(F.col("issue_id") % 7 == 0, F.lit("pr"))})
    return issue_scan.scan_recent(issues, views.skip_urls(spark, folder)).select("issue_id", "pattern_rank", "secret_type")
