"""Quality of predictions.

Every metric is a projection of one grouped count, so a data set is read once
and the shuffle carries a few rows per task.  ``by`` names optional columns
(for example the model) to evaluate apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.features import NOT_SECRET, SECRET
from .selection import keep_first, top_k_per_group


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where undefined."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def confusion(df: DataFrame, by: list[str] | None = None, truth: str = "label", guess: str = "prediction") -> DataFrame:
    """tn, fp, fn, tp."""
    t, g = F.col(truth), F.col(guess)
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    counts = [F.count_if((t == a) & (g == b)).alias(name) for name, (a, b) in cells.items()]
    return df.groupBy(*(by or [])).agg(*counts)


def binary_metrics(cells: DataFrame) -> DataFrame:
    """Add precision, recall and F1 of the positive class."""
    tp = F.col("tp")
    return (
        cells.withColumn("precision", ratio(tp, tp + F.col("fp")))
        .withColumn("recall", ratio(tp, tp + F.col("fn")))
        .withColumn("f1", f1(F.col("precision"), F.col("recall")))
    )


def class_metrics(df: DataFrame, by: list[str] | None = None, truth: str = "label", guess: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs as truth or guess."""
    by = by or []
    pairs = df.groupBy(*by, F.col(truth).alias("_t"), F.col(guess).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    # Each cell counts for its true class, its predicted class, or once for both.
    sides = F.explode(F.array_distinct(F.array("_t", "_g")))
    hit = (F.col("class") == F.col("_t")) & (F.col("class") == F.col("_g"))
    totals = (
        pairs.withColumn("class", sides)
        .groupBy(*by, "class")
        .agg(
            F.sum(F.when(hit, F.col("_n")).otherwise(0)).alias("_tp"),
            F.sum(F.when(F.col("_g") == F.col("class"), F.col("_n")).otherwise(0)).alias("_predicted"),
            F.sum(F.when(F.col("_t") == F.col("class"), F.col("_n")).otherwise(0)).alias("support"),
        )
    )
    return (
        totals.withColumn("precision", ratio(F.col("_tp"), F.col("_predicted")))
        .withColumn("recall", ratio(F.col("_tp"), F.col("support")))
        .withColumn("f1", f1(F.col("precision"), F.col("recall")))
        .select(*by, "class", "precision", "recall", "f1", "support")
    )


def macro_average(per_class: DataFrame, by: list[str] | None = None) -> DataFrame:
    return per_class.groupBy(*(by or [])).agg(*[F.avg(m).alias(m) for m in ("precision", "recall", "f1")])


def weighted_average(per_class: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Average by support."""
    weighted = lambda m: ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m)
    return per_class.groupBy(*(by or [])).agg(*[weighted(m) for m in ("precision", "recall", "f1")])


def accuracy(df: DataFrame, by: list[str] | None = None, truth: str = "label", guess: str = "prediction") -> DataFrame:
    """Share of right predictions; with ``by=[truth]`` the accuracy per true class."""
    right = F.count_if(F.col(truth) == F.col(guess))
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), ratio(right, F.count(F.lit(1))).alias("accuracy"))


def sensitivity_specificity(cells: DataFrame) -> DataFrame:
    return cells.withColumn("sensitivity", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn(
        "specificity", ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    )


def _band(count: Column, rate: Column) -> Column:
    return F.when(count == 0, "none").when(rate < 0.05, "low").when(rate < 0.10, "moderate").otherwise("high")


def risk_bands(cells: DataFrame) -> DataFrame:
    """Rates of missed secrets and false alarms, with their bands."""
    return (
        cells.withColumn("fn_rate", ratio(F.col("fn"), F.col("tp") + F.col("fn")))
        .withColumn("fp_rate", ratio(F.col("fp"), F.col("tn") + F.col("fp")))
        .withColumn("security_risk", _band(F.col("fn"), F.col("fn_rate")))
        .withColumn("usability_impact", _band(F.col("fp"), F.col("fp_rate")))
    )


def quality_band(accuracy_column: Column) -> Column:
    return (
        F.when(accuracy_column >= 0.95, "excellent")
        .when(accuracy_column >= 0.90, "good")
        .when(accuracy_column >= 0.80, "acceptable")
        .otherwise("poor")
    )


def error_type(truth: Column, guess: Column) -> Column:
    """Truth and guess as label names."""
    return (
        F.when(truth == guess, "Correct")
        .when((truth == NOT_SECRET) & (guess == SECRET), "False Positive")
        .when((truth == SECRET) & (guess == NOT_SECRET), "False Negative")
        .otherwise("Other Error")
    )


def tag_errors(df: DataFrame) -> DataFrame:
    """Detailed predictions: expects actual_label, predicted_label (names),
    candidate_string and context_window."""
    kind = error_type(F.col("actual_label"), F.col("predicted_label"))
    return (
        df.withColumn("error_type", kind)
        .withColumn("correct", F.col("error_type") == "Correct")
        .withColumn("candidate_length", F.length("candidate_string"))
        .withColumn("context_length", F.coalesce(F.length("context_window"), F.lit(0)))
    )


def worst_errors(tagged: DataFrame, order: list[Column], k: int = fv.ERRORS_SHOWN) -> DataFrame:
    """The first ``k`` errors of each kind with a preview of the context."""
    context = F.coalesce(F.col("context_window"), F.lit(""))
    preview = F.when(
        F.length(context) > fv.PREVIEW_LENGTH, F.concat(F.substring(context, 1, fv.PREVIEW_LENGTH), F.lit("..."))
    ).otherwise(context)
    errors = tagged.filter(F.col("error_type").isin("False Positive", "False Negative"))
    return top_k_per_group(errors.withColumn("preview", preview), ["error_type"], order, k, rank="error_no")


def error_lengths(tagged: DataFrame) -> DataFrame:
    """Candidate lengths per kind of error."""
    length = F.col("candidate_length")
    return (
        tagged.filter(F.col("error_type").isin("False Positive", "False Negative"))
        .groupBy("error_type")
        .agg(F.avg(length).alias("avg_length"), F.min(length).alias("min_length"), F.max(length).alias("max_length"))
    )


def prediction_validity(df: DataFrame, guess: str = "predicted_label") -> DataFrame:
    """How many answers are one of the two labels."""
    valid = F.coalesce(F.col(guess).isin(SECRET, NOT_SECRET), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid")
    )


def normalized_confusion(cells: DataFrame) -> DataFrame:
    """Each cell as a share of its true class, 0 for a class without rows."""
    negatives, positives = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    shares = {"tn": negatives, "fp": negatives, "fn": positives, "tp": positives}
    return cells.select(
        *[c for c in cells.columns if c not in shares], *[ratio(F.col(c), total).alias(c) for c, total in shares.items()]
    )


def leaderboard(df: DataFrame, model: str = "model") -> DataFrame:
    """All models of a long table in one pass, best F1 first (then by name)."""
    cells = binary_metrics(confusion(df, [model]))
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    # One row per model.
    place = F.row_number().over(W.orderBy(F.round("f1", 9).desc(), model))
    return cells.select(
        model, ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"), "precision", "recall", "f1"
    ).withColumn("place", place)


def best_epoch(metrics: DataFrame, metric: str = "f1", epoch: str = "epoch", model: str | None = None) -> DataFrame:
    """The epoch with the best value, of every model if its column is named; the first one on a tie."""
    order = [F.col(metric).desc(), F.col(epoch)]
    return metrics.orderBy(*order).limit(1) if model is None else keep_first(metrics, [model], order)
