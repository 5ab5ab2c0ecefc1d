"""Evaluation of predictions (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.features import label_name
from ..functions.text import context_window
from ..operators import evaluate as ev
from . import sql as q
from . import views
from .base import query

_CELLS = """SELECT model, count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp
    FROM model_predictions GROUP BY model"""
_DIV = lambda a, b: f"coalesce({a} / nullif({b}, 0)::DOUBLE, 0)"
_CLASSES = """SELECT model, class, count(*) FILTER (label = class AND prediction = class) AS hit,
    count(*) FILTER (prediction = class) AS guessed, count(*) FILTER (label = class) AS support
    FROM model_predictions, (VALUES (0), (1)) v(class) GROUP BY ALL"""
_RATES = f"SELECT model, class, support, {_DIV('hit', 'guessed')} AS precision, {_DIV('hit', 'support')} AS recall FROM classes"
_PER_CLASS = f"SELECT *, {_DIV('2 * precision * recall', '(precision + recall)')} AS f1 FROM rates"
_METRICS = dict(classes=_CLASSES, rates=_RATES, per_class=_PER_CLASS)


def _predictions(spark, folder):
    return views.model_predictions(spark, folder).select("issue_id", "model", "label", "prediction")


def _cells(spark, folder):
    return ev.confusion(_predictions(spark, folder), ["model"])


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _check(select: str, **extra) -> str:
    return q.with_views("model_predictions", select, cells=_CELLS, **extra)


@query("H1_confusion", _check("SELECT * FROM cells"))
def confusion(spark, folder):
    return _cells(spark, folder)


_P, _R = _DIV("tp", "(tp + fp)"), _DIV("tp", "(tp + fn)")


@query("H2_binary_metrics", _check(f"""SELECT model, round(p, 6) AS precision, round(r, 6) AS recall,
    round({_DIV('2 * p * r', '(p + r)')}, 6) AS f1 FROM (SELECT model, {_P} AS p, {_R} AS r FROM cells)"""))
def binary_metrics(spark, folder):
    metrics = ev.binary_metrics(_cells(spark, folder)).select("model", "precision", "recall", "f1")
    return _rounded(metrics, "precision", "recall", "f1")


@query("H3_class_metrics", _check(
    "SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per_class", **_METRICS))
def class_metrics(spark, folder):
    return _rounded(ev.class_metrics(_predictions(spark, folder), ["model"]), "precision", "recall", "f1")


@query("H4_macro_average", _check(
    "SELECT model, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM per_class GROUP BY 1", **_METRICS))
def macro_average(spark, folder):
    return _rounded(ev.macro_average(ev.class_metrics(_predictions(spark, folder), ["model"]), ["model"]), "precision", "recall", "f1")


_WAVG = lambda m: f"round(sum({m} * support) / sum(support), 6) AS {m}"


@query("H5_weighted_average", _check(
    f"SELECT model, {_WAVG('precision')}, {_WAVG('recall')}, {_WAVG('f1')} FROM per_class GROUP BY 1", **_METRICS))
def weighted_average(spark, folder):
    return _rounded(ev.weighted_average(ev.class_metrics(_predictions(spark, folder), ["model"]), ["model"]), "precision", "recall", "f1")


@query("H6_accuracy", _check("""SELECT model, coalesce(label::VARCHAR, 'all') AS class, count(*) AS n,
    round(avg((label = prediction)::INT), 6) AS accuracy FROM model_predictions GROUP BY GROUPING SETS ((model), (model, label))"""))
def accuracy(spark, folder):
    rows = _predictions(spark, folder)
    overall = ev.accuracy(rows, ["model"]).withColumn("class", F.lit("all"))
    per_class = ev.accuracy(rows, ["model", "label"]).withColumn("class", F.col("label").cast("string")).drop("label")
    return _rounded(overall.unionByName(per_class), "accuracy")


@query("H7_sensitivity_specificity", _check(
    f"SELECT model, round({_R}, 6) AS sensitivity, round({_DIV('tn', '(tn + fp)')}, 6) AS specificity FROM cells"))
def sensitivity(spark, folder):
    rates = ev.sensitivity_specificity(_cells(spark, folder)).select("model", "sensitivity", "specificity")
    return _rounded(rates, "sensitivity", "specificity")


_BAND = lambda n, r: f"CASE WHEN {n} = 0 THEN 'none' WHEN {r} < 0.05 THEN 'low' WHEN {r} < 0.1 THEN 'moderate' ELSE 'high' END"


@query("H8_risk_bands", _check(f"""SELECT model, round(a, 6) AS fn_rate, round(b, 6) AS fp_rate, {_BAND('fn', 'a')} AS security_risk,
    {_BAND('fp', 'b')} AS usability_impact FROM (SELECT *, {_DIV('fn', '(tp + fn)')} AS a, {_DIV('fp', '(tn + fp)')} AS b FROM cells)"""))
def risk_bands(spark, folder):
    bands = ev.risk_bands(_cells(spark, folder)).select("model", "fn_rate", "fp_rate", "security_risk", "usability_impact")
    return _rounded(bands, "fn_rate", "fp_rate")


@query("H9_quality_band", _check("""SELECT model, CASE WHEN a >= .95 THEN 'excellent' WHEN a >= .9 THEN 'good' WHEN a >= .8 THEN 'acceptable'
    ELSE 'poor' END AS quality FROM (SELECT model, avg((label = prediction)::INT) AS a FROM model_predictions GROUP BY 1)"""))
def quality_band(spark, folder):
    rates = ev.accuracy(_predictions(spark, folder), ["model"])
    return rates.select("model", ev.quality_band(F.col("accuracy")).alias("quality"))


_TAGGED = f"""SELECT issue_id, model, candidate_string, {q.window('text', 'candidate_string', 200)} AS context_window,
    CASE WHEN label = prediction THEN 'Correct' WHEN label = 0 THEN 'False Positive' ELSE 'False Negative' END AS error_type,
    label = prediction AS correct, length(candidate_string)::INT AS candidate_length FROM model_predictions"""


def tagged(spark, folder):
    rows = views.model_predictions(spark, folder).select(
        "issue_id", "model", "candidate_string", context_window(F.col("text"), F.col("candidate_string")).alias("context_window"),
        label_name(F.col("label")).alias("actual_label"), label_name(F.col("prediction")).alias("predicted_label"))
    return ev.tag_errors(rows)


@query("H10_error_tags", q.with_views("model_predictions", """SELECT issue_id, model, error_type, correct, candidate_length,
    coalesce(length(context_window), 0)::INT AS context_length FROM tagged""", tagged=_TAGGED))
def error_tags(spark, folder):
    return tagged(spark, folder).select("issue_id", "model", "error_type", "correct", "candidate_length", "context_length")


@query("H11_worst_errors", q.with_views("model_predictions", """SELECT error_type, no::INT AS error_no, issue_id, model,
    CASE WHEN length(context_window) > 200 THEN substr(context_window, 1, 200) || '...' ELSE context_window END AS preview
    FROM (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY issue_id, model) AS no FROM tagged WHERE NOT correct) WHERE no <= 10""",
    tagged=_TAGGED))
def worst_errors(spark, folder):
    worst = ev.worst_errors(tagged(spark, folder), [F.col("issue_id"), F.col("model")])
    return worst.select("error_type", "error_no", "issue_id", "model", "preview")


@query("H12_error_lengths", q.with_views("model_predictions", """SELECT error_type, round(avg(candidate_length), 6) AS avg_length,
    min(candidate_length) AS min_length, max(candidate_length) AS max_length FROM tagged WHERE NOT correct GROUP BY 1""", tagged=_TAGGED))
def error_lengths(spark, folder):
    return _rounded(ev.error_lengths(tagged(spark, folder)), "avg_length")


@query("H13_prediction_validity", q.with_views("responses", """SELECT count(*) AS total, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid
    FROM (SELECT response IN ('Secret', 'Non-sensitive') AS ok FROM responses)"""))
def validity(spark, folder):
    return ev.prediction_validity(views.responses(spark, folder), "response")


@query("H14_normalized_confusion", _check(f"""SELECT model, round({_DIV('tn', '(tn + fp)')}, 6) AS tn, round({_DIV('fp', '(tn + fp)')}, 6) AS fp,
    round({_DIV('fn', '(fn + tp)')}, 6) AS fn, round({_DIV('tp', '(fn + tp)')}, 6) AS tp FROM cells"""))
def normalized(spark, folder):
    return _rounded(ev.normalized_confusion(_cells(spark, folder)), "tn", "fp", "fn", "tp")


@query("H15_leaderboard", _check(f"""SELECT model, round(a, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
    (row_number() OVER (ORDER BY round(f, 9) DESC, model))::INT AS place
    FROM (SELECT *, {_DIV('2 * p * r', '(p + r)')} AS f FROM
    (SELECT model, {_DIV('(tp + tn)', '(tp + tn + fp + fn)')} AS a, {_P} AS p, {_R} AS r FROM cells))"""))
def leaderboard(spark, folder):
    return _rounded(ev.leaderboard(_predictions(spark, folder)), "accuracy", "precision", "recall", "f1")


# Epochs: each model judged on a tenth of the issues.
@query("H16_best_epoch", q.with_views("model_predictions", """SELECT model, epoch, round(f1, 6) AS f1 FROM scores
        QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(f1, 9) DESC, epoch) = 1""",
    cells="""SELECT model, issue_id % 10 AS epoch, class, count(*) FILTER (label = class AND prediction = class) AS hit,
        count(*) FILTER (prediction = class) AS guessed, count(*) FILTER (label = class) AS support
        FROM model_predictions, (VALUES (0), (1)) v(class) GROUP BY ALL HAVING guessed + support > 0""",
    scores=f"SELECT model, epoch, avg({_DIV('2 * hit', '(guessed + support)')}) AS f1 FROM cells GROUP BY ALL"))
def best_epoch(spark, folder):
    rows = views.model_predictions(spark, folder).withColumn("epoch", F.col("issue_id") % 10)
    macro = ev.macro_average(ev.class_metrics(rows, ["model", "epoch"]), ["model", "epoch"]).withColumn("f1", F.round("f1", 9))
    return _rounded(ev.best_epoch(macro.select("model", "epoch", "f1"), model="model"), "f1")
