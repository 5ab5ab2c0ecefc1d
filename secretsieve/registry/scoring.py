"""Scoring and model data work (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.features import FEATURE_COLUMNS, FLAG_COLUMNS, add_features, label_name
from ..functions.text import context_window
from ..operators import certificates, evaluate, neighbours, scoring
from ..session import shared_folder
from ..sources import sinks
from . import sql as q
from . import views
from .base import query
from .rules import features_sql


def _featured(spark, folder):
    """Training and test rows with features; a document is in one part only."""
    rows = add_features(views.labelled_tokens(spark, folder)).select("id", "label", "split", *FEATURE_COLUMNS)
    return rows.filter("split <> 'test'"), rows.filter("split = 'test'")


_PARTS = {
    **features_sql("labelled_tokens"), "train": "SELECT * FROM features WHERE split <> 'test'",
    "test": "SELECT * FROM features WHERE split = 'test'",
}


# --------------------------------------------------------------- F1-F5: models
# A fitted model has no SQL form.  Its confusions must cover both parts, and it must be what its training rows call for
# (see operators.certificates): that is ``good``, which SQL expects to be true.
_TOTALS = """SELECT {model} AS model, part, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative, TRUE AS good
    FROM (SELECT label, 'test' AS part FROM test UNION ALL SELECT label, 'train' FROM train) GROUP BY part"""


def _judged(train, test, good: bool):
    """Class totals of both parts, which have ``model`` and ``prediction``."""
    rows = train.select("model", "label", "prediction", F.lit("train").alias("part")).unionByName(
        test.select("model", "label", "prediction", F.lit("test").alias("part")))
    cells = evaluate.confusion(rows, ["model", "part"])
    positive, negative = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return cells.select("model", "part", positive.alias("n_positive"), negative.alias("n_negative"), F.lit(good).alias("good"))


def _certified(model: str, fitted, train) -> bool:
    vectors = scoring.distinct_vectors(train)
    if model == "logistic_regression":
        return certificates.logistic_gradient(fitted, vectors) <= certificates.GRADIENT
    if model in ("linear_svm", "rbf_svm"):
        return certificates.hinge_improvement(fitted, vectors) <= certificates.LOSS
    if model == "decision_tree":
        return certificates.tree_fits(fitted, vectors)
    return certificates.forest_fits(fitted, scoring.bootstrap_counts(vectors, scoring.TREES), scoring.fit("decision_tree", train))


def _fitted(name: str, model: str):
    @query(name, q.with_views("labelled_tokens", _TOTALS.format(model=q.quote(model)), **_PARTS))
    def run(spark, folder):
        """Fits on the training part, checks the model against it and judges the confusions of both parts."""
        train, test = _featured(spark, folder)
        fitted = scoring.fit(model, train)
        return _judged(*[scoring.predict(fitted, part).withColumn("model", F.lit(model)) for part in (train, test)], _certified(model, fitted, train))


_fitted("F1_decision_tree", "decision_tree")
_fitted("F2_random_forest", "random_forest")
_fitted("F3_logistic_regression", "logistic_regression")
_fitted("F4_linear_svm", "linear_svm")
_fitted("F4_rbf_svm", "rbf_svm")

_MOMENTS = "SELECT label, count(*) AS n, " + ", ".join(f"avg({f}) AS m_{f}, var_pop({f}::DOUBLE) AS v_{f}" for f in FEATURE_COLUMNS) + " FROM train GROUP BY 1"
_FLOOR = "SELECT 1e-9 * greatest(" + ", ".join(f"var_pop({f}::DOUBLE)" for f in FEATURE_COLUMNS) + ") AS eps FROM train"
_LIKELIHOOD = "SELECT t.id, s.label AS class, ln(s.n / (SELECT sum(n) FROM moments)) - 0.5 * (" + " + ".join(
    f"ln(2 * pi() * (v_{f} + eps)) + (t.{f} - m_{f}) ** 2 / (v_{f} + eps)" for f in FEATURE_COLUMNS) + ") AS ll FROM test t, moments s, floors"


@query("F5_gaussian_naive_bayes", q.with_views("labelled_tokens", """SELECT id,
    (round(max(ll) FILTER (class = 1), 6) > round(max(ll) FILTER (class = 0), 6))::INT AS prediction FROM likelihoods GROUP BY 1""",
    **_PARTS, moments=_MOMENTS, floors=_FLOOR, likelihoods=_LIKELIHOOD))
def gaussian_naive_bayes(spark, folder):
    train, test = _featured(spark, folder)
    return scoring.fit_gaussian(train).score(test).select("id", "prediction")


@query("F5_naive_bayes_fitted", q.with_views("labelled_tokens", """SELECT id,
    (max(ll) FILTER (class = 1) > max(ll) FILTER (class = 0))::INT AS prediction FROM likelihoods GROUP BY 1""",
    **_PARTS, moments=_MOMENTS, floors=_FLOOR, likelihoods=_LIKELIHOOD))
def naive_bayes_fitted(spark, folder):
    train, test = _featured(spark, folder)
    return scoring.predict(scoring.fit("naive_bayes", train), test).select("id", "prediction")


# ------------------------------------------------------------------ F6: neighbours
_BITS = " + ".join(f"({name}::BIGINT << {i})" for i, name in enumerate(FLAG_COLUMNS))
_VECTOR = f"SELECT id, label, {_BITS} AS bits, round(entropy_value * 1000000)::BIGINT AS micro FROM "


@query("F6_nearest_neighbours", q.with_views("labelled_tokens", """SELECT id, (2 * sum(label) > count(*))::INT AS prediction FROM near GROUP BY 1""",
    **_PARTS, train_points=_VECTOR + "train", test_points=_VECTOR + "test",
    near="""SELECT t.id, r.label FROM test_points t, train_points r QUALIFY row_number() OVER (PARTITION BY t.id
        ORDER BY bit_count(xor(t.bits, r.bits))::BIGINT * 1000000000000 + (t.micro - r.micro) * (t.micro - r.micro), r.id) <= 5"""))
def nearest_neighbours(spark, folder):
    train, test = _featured(spark, folder)
    return neighbours.nearest_neighbours(train, test).select("id", "prediction")


# ------------------------------------------------------------------ F7-F8: ensembles
@query("F7_majority_vote", q.with_views("model_predictions", "SELECT issue_id, (sum(prediction) >= 2)::INT AS prediction FROM model_predictions GROUP BY 1"))
def majority_vote(spark, folder):
    names = ["short", "long", "marked"]
    wide = views.model_predictions(spark, folder).groupBy("issue_id").pivot("model", names).agg(F.max("prediction"))
    return scoring.majority_vote(wide, names).select("issue_id", "prediction")


@query("F7_fitted_vote", q.with_views("labelled_tokens", _TOTALS.format(model="'vote'"), **_PARTS))
def fitted_vote(spark, folder):
    """Logistic regression, linear SVM and naive Bayes vote on both parts."""
    train, test = _featured(spark, folder)
    train = train.persist()
    try:
        models = {name: scoring.fit(name, train) for name in ("logistic_regression", "linear_svm")}
        gaussian = scoring.fit_gaussian(train)
        good = all(_certified(name, model, train) for name, model in models.items())
    finally:
        train.unpersist()

    def voted(part):
        for name, model in models.items():
            part = scoring.predict(model, part, name)
        part = gaussian.score(part).withColumnRenamed("prediction", "naive_bayes")
        return scoring.majority_vote(part, [*models, "naive_bayes"]).withColumn("model", F.lit("vote"))

    return _judged(voted(train), voted(test), good)


@query("F8_average_probabilities", q.with_views("", """SELECT doc_id, p1 AS candidate_prob_1, p2 AS context_prob_1, round((p1 + p2) / 2, 6) AS ensemble_prob_1,
    (p1 > .5)::INT AS candidate_pred, (p2 > .5)::INT AS context_pred, (round((p1 + p2) / 2, 9) > .5)::INT AS ensemble_pred
    FROM (SELECT doc_id, (doc_id * 37 % 100) / 100.0::DOUBLE AS p1, (doc_id * 53 % 100) / 100.0::DOUBLE AS p2 FROM documents)"""))
def average_probabilities(spark, folder):
    documents = views.table(spark, folder, "documents")
    score = lambda n, name: documents.select("doc_id", (F.col("doc_id") * n % 100 / 100).alias(name))
    both = scoring.average_probabilities(score(37, "candidate_prob_1"), score(53, "context_prob_1"), "doc_id")
    return both.withColumn("ensemble_prob_1", F.round("ensemble_prob_1", 6))


# --------------------------------------------------------------------- F9-F12: prompts
_CONTEXTS = f"SELECT issue_id, candidate_string, {q.window('text', 'candidate_string')} AS context_window, label FROM labelled"
_ASK = "'candidate_string: ' || candidate_string || '\nissue_report: ' || coalesce(context_window, '')"


def _shown() -> str:
    return "\n\n".join(f"Example {i}:\ncandidate_string: {c}\nissue_report: {r}\nlabel: {n}" for i, (c, r, n) in enumerate(prompts.EXAMPLES, 1))


_PROMPTS = {
    "zero_shot": f"{q.quote(prompts.TASK + chr(10) * 2)} || {_ASK} || '\nlabel:'",
    "few_shot": f"{q.quote(prompts.TASK + chr(10) * 2 + _shown() + chr(10) * 2 + 'Now the case to decide:' + chr(10))} || {_ASK} || '\nlabel:'",
    **{chat: f"{q.quote(f[0] + prompts.TASK + f[1])} || {_ASK} || {q.quote(f[2])}" for chat, f in prompts.CHAT_FORMATS.items()},
}


def _contexts(spark, folder):
    window = context_window(F.col("text"), F.col("candidate_string"))
    return views.labelled(spark, folder).select("issue_id", "candidate_string", window.alias("context_window"), "label")


@query("F9_prompts", q.with_views("labelled", "SELECT issue_id, " + ", ".join(f"md5({e}) AS {n}" for n, e in _PROMPTS.items()) + " FROM contexts", contexts=_CONTEXTS))
def render_prompts(spark, folder):
    c, w = F.col("candidate_string"), F.col("context_window")
    columns = {"zero_shot": prompts.zero_shot_prompt(c, w), "few_shot": prompts.few_shot_prompt(c, w)}
    columns |= {chat: prompts.chat_prompt(c, w, chat) for chat in prompts.CHAT_FORMATS}
    return _contexts(spark, folder).select("issue_id", *[F.md5(p).alias(n) for n, p in columns.items()])


@query("F10_training_texts", q.with_views("labelled", "SELECT issue_id, " + ", ".join(
    f"md5({_PROMPTS[chat]} || CASE label WHEN 1 THEN 'Secret' ELSE 'Non-sensitive' END || {q.quote(f[3])}) AS {chat}"
    for chat, f in prompts.CHAT_FORMATS.items()) + " FROM contexts", contexts=_CONTEXTS))
def training_texts(spark, folder):
    c, w, label = F.col("candidate_string"), F.col("context_window"), label_name(F.col("label"))
    return _contexts(spark, folder).select(
        "issue_id", *[F.md5(prompts.chat_prompt(c, w, chat, label)).alias(chat) for chat in prompts.CHAT_FORMATS])


_STRICT = """CASE WHEN replace(replace(trim(response), '''', ''), '"', '') IN ('Secret', 'Non-sensitive')
    THEN replace(replace(trim(response), '''', ''), '"', '') ELSE 'Non-sensitive' END"""


@query("F11_parse_strict", q.with_views("responses", f"SELECT conv_id, turn, {_STRICT} AS predicted_label FROM responses"))
def parse_strict(spark, folder):
    return views.responses(spark, folder).select("conv_id", "turn", prompts.parse_strict(F.col("response")).alias("predicted_label"))


# Every third conversation echoes its prompt, which names both labels, without an answer mark.
@query("F12_parse_loose", q.with_views("responses", f"""SELECT conv_id, turn, CASE WHEN contains(string_split(
        CASE WHEN conv_id % 3 = 0 AND NOT contains(response, '<|im_start|>assistant') THEN substr(echoed, length({q.quote(prompts.TASK)}) + 1)
        ELSE echoed END, '<|im_start|>assistant')[-1], 'Secret') THEN 'Secret' ELSE 'Non-sensitive' END AS predicted_label FROM answers""",
    answers=f"SELECT *, CASE WHEN conv_id % 3 = 0 THEN {q.quote(prompts.TASK)} || response ELSE response END AS echoed FROM responses"))
def parse_loose(spark, folder):
    prompt = F.lit(prompts.TASK)
    echoed = F.when(F.col("conv_id") % 3 == 0, F.concat(prompt, "response")).otherwise(F.col("response"))
    return views.responses(spark, folder).select("conv_id", "turn", prompts.parse_loose(echoed, prompt=prompt).alias("predicted_label"))


# ------------------------------------------------------------------- F13-F14: scorer
@query("F13_score_batches", q.with_views("token_contexts", """SELECT issue_id, candidate_string,
    CASE WHEN NOT contains(candidate_string, '%') AND regexp_matches(candidate_string, '[0-9]') THEN 'Secret' ELSE 'Non-sensitive' END AS predicted_label,
    CASE WHEN contains(candidate_string, '%') THEN 'ValueError: unreadable candidate' END AS error FROM token_contexts"""))
def score_batches(spark, folder):
    # Defined here, the function travels to the workers by value.
    def digit_scorer(batch):
        """A stand-in for a model: digits mark a secret; it cannot read ``%``."""
        if batch["candidate_string"].str.contains("%", regex=False).any():
            raise ValueError("unreadable candidate")
        return batch["candidate_string"].str.contains("[0-9]").map({True: "Secret", False: "Non-sensitive"})

    rows = views.token_contexts(spark, folder)
    return scoring.score_batches(rows, digit_scorer).select("issue_id", "candidate_string", "predicted_label", "error")


@query("F14_progress", q.with_views("responses", """SELECT count(*) AS total, count(*) FILTER (response <> 'maybe') AS done,
    count(*) FILTER (response = 'maybe') AS remaining FROM responses"""))
def progress(spark, folder):
    answered = views.responses(spark, folder).withColumn("predicted_label", F.nullif(F.col("response"), F.lit("maybe")))
    return scoring.progress(answered)


@query("F14_progress_of_write", q.with_views("responses", """SELECT count(*) AS total, count(*) FILTER (response <> 'maybe') AS done,
    count(*) FILTER (response = 'maybe') AS remaining, count(*) AS written FROM responses"""))
def progress_of_write(spark, folder):
    """Counted by the job that writes the answers; a second look only counts what lies there."""
    path = shared_folder(spark, "answers")
    answered = views.responses(spark, folder).withColumn("predicted_label", F.nullif(F.col("response"), F.lit("maybe")))
    seen = sinks.write_with_progress(answered, path)
    return spark.read.parquet(path).agg(*[F.lit(seen[n]).alias(n) for n in ("total", "done", "remaining")], F.count(F.lit(1)).alias("written"))
