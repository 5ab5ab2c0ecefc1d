"""Quality and toxicity by hierarchical empirical Bayes.

1. Evidence of a document: a naive Bayes classifier over its distinct words and
   word shapes, fitted on at most ``max_labelled`` labelled documents (those with the least hashes of their ids).
   Of near copies in the sample one counts, else the words of a copied text would look like evidence: a document goes if it shares
   a least shingle hash, or two, with one of a smaller id and four fifths of their shingles.  Only features with a likelihood-ratio statistic of
   ``min_evidence`` and log odds of ``min_odds`` count, so neither chance words nor the sum of many common words decides.  The evidence is a log likelihood ratio, free of any prior.
2. Sites: the mean class probability of a host is shrunk toward the global mean, and that of a path of
   the host toward its host.  A prior's strength is estimated by moments: the less sites differ beyond
   chance, the more they are shrunk; sites with few documents take their parent's mean.
   Every labelled document gives its label, whether it was fitted on or not; any other its probability.
3. A document's probability has its path's posterior mean, without its own share, as prior odds and its evidence
   as likelihood ratio.

Texts are read twice and never shuffled: the fitting sample is bounded, so it is sent to the
scan.  All labels are joined with the narrow rows by id.  Sites are grouped sums with map-side combining.

Defined results: a null or empty text has no evidence and takes its site's prior; null
hosts and paths are sites; labels with nulls are not used, and of repeated labels of an id the greatest counts; repeated rows get a row
each; without labels there is no evidence and all probabilities are 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CAPITALS, SMALL, byte_texts, landed, map_batches, mixed
from .minhash import shingle_hashes

LOWER = bytes.maketrans(CAPITALS.encode(), SMALL.encode())
SHAPE = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)
TARGETS = ("quality", "toxic")
EDGE = 1e-6


def features(text: bytes) -> np.ndarray:
    """Hashes of a document's distinct words, of the distinct ends of its words' shapes, and of three rounded
    shares: distinct words among all, words that begin with a letter, and words that repeat the one before."""
    words = text.translate(LOWER).split()
    distinct, shaped = set(words), text.translate(SHAPE).split()
    shapes = {b" " + w[:2] + b" " + w[-3:] for w in shaped}
    letters = sum([w[0] in b"aA" for w in shaped])
    doubled = sum(map(bytes.__eq__, words, words[1:]))
    counted = ((b"distinct", 5 * len(distinct)), (b"letters", 10 * letters), (b"doubled", 10 * doubled))
    shares = [b" %b %d" % (name, n // len(words)) for name, n in counted] if len(words) >= 20 else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, [*distinct, *shapes, *shares]), dtype=np.uint64)
    return h.view(np.int64)


def one_per_id(labels: DataFrame, id_col: str) -> DataFrame:
    """All labels without nulls, one row per id."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), *[F.col(t).cast("int").alias(t) for t in TARGETS]).dropna()
    return known.groupBy("_id").agg(*[F.max(t).alias(t) for t in TARGETS])


def labelled_sample(known: DataFrame, max_labelled: int) -> DataFrame:
    """At most ``max_labelled`` labelled ids, those with the least hashes.  A threshold that leaves somewhat more keeps the sort short."""
    n, order = known.count(), F.xxhash64("_id")
    if n > max_labelled:
        share = (max_labelled + 10 * max_labelled**0.5 + 100) / n
        near = known.filter(order < F.lit(int(min(1.0, share) * (1 << 64)) - (1 << 63) - 1))
        known = near if share < 1 and near.count() >= max_labelled else known
    return known.orderBy(order, "_id").limit(max_labelled)


def likeness(a: bytes, b: bytes) -> float:
    """Shared part of the distinct shingles of two texts; of two texts without words 1."""
    x, y = np.unique(shingle_hashes(a)), np.unique(shingle_hashes(b))
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if len(x) or len(y) else 1.0


def without_copies(rows: DataFrame, least_likeness: float = 0.8) -> DataFrame:
    """Documents (_id, _text) without those that are near copies of one with a smaller id.

    Candidates are the least id of the documents with the same least shingle hash under one of three orders,
    and under two of them; their texts are compared."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = [[], [], []]
            for text in byte_texts(b.column(1)):
                h = shingle_hashes(text)
                for i, column in enumerate(least):
                    column.append(int(mixed(h + np.uint64(i)).min()) - (1 << 63) if len(h) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in least]], names=["_id", "m0", "m1", "m2"])

    def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [likeness(x, y) >= least_likeness for x, y in zip(byte_texts(b.column(1)), byte_texts(b.column(2)))]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(found, pa.bool_()))], names=["_id"])

    sketches = landed(map_batches(rows.select("_id", "_text"), run, "_id long, m0 long, m1 long, m2 long"), "sketches")
    shared = [("m0",), ("m1",), ("m2",), ("m0", "m1"), ("m0", "m2"), ("m1", "m2")]
    keys = sketches.select("_id", F.explode(F.array(*[F.xxhash64(F.lit(i), *names) for i, names in enumerate(shared)])).alias("key"))
    pairs = keys.join(keys.groupBy("key").agg(F.min("_id").alias("_first")), "key").filter("_first < _id").select("_id", "_first").distinct()
    texts = rows.select("_id", "_text")
    both = pairs.join(texts, "_id").join(texts.select(F.col("_id").alias("_first"), F.col("_text").alias("_other")), "_first")
    copies = landed(map_batches(both.select("_id", "_text", "_other"), alike, "_id long").distinct(), "copies")
    return rows.join(F.broadcast(copies), "_id", "left_anti")  # bounded by max_labelled


def surprise(k: Column, n: Column, rate: float) -> Column:
    """Likelihood-ratio statistic of k marked documents among n against the rate of all."""
    part = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
    return 2 * (part(k, n * F.lit(rate)) + part(n - k, n * F.lit(1 - rate)))


def fit(
    df: DataFrame, sample: DataFrame, id_col: str, text_col: str, min_evidence: float, min_odds: float
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features that count, ascending, and their log odds per target."""
    rows = df.select(df[id_col].cast("long").alias("_doc"), df[text_col].alias("_text")).join(
        F.broadcast(sample), F.col("_doc") == F.col("_id")  # bounded by max_labelled
    ).select("_id", "_text", *TARGETS)
    rows = without_copies(rows).select("_text", *TARGETS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                found = [features(x) for x in byte_texts(b.column(0))]
                values, at = np.unique(np.concatenate([*found, np.zeros(1, np.int64)]), return_inverse=True)
                at, sizes = at[:-1], [len(x) for x in found]
                marks = [np.repeat(b.column(t).to_numpy(), sizes) for t in TARGETS]
                count = lambda w: pa.array(np.bincount(at, weights=w, minlength=len(values)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), count(np.ones(len(at))), *[count(m) for m in marks]], names=["feature", "n", *TARGETS]
                )

    counts = map_batches(rows, run, "feature long, n long, " + ", ".join(f"{t} long" for t in TARGETS))
    counts = counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)]).filter("n >= 4")
    n, *ones = rows.agg(F.count(F.lit(1)), *[F.sum(t) for t in TARGETS]).first()
    if not n:
        return np.array([], dtype=np.int64), np.zeros((0, len(TARGETS)))
    odds = []
    for t, one in zip(TARGETS, ones):
        one = int(one or 0)
        yes, no = F.col(t) + 0.5, F.col("n") - F.col(t) + 0.5
        value = F.log(yes / F.lit(one + 1.0)) - F.log(no / F.lit(n - one + 1.0))
        if not 0 < one < n:
            odds.append(F.lit(0.0).alias(f"w_{t}"))
            continue
        counts_for = (surprise(F.col(t), F.col("n"), one / n) >= min_evidence) & (F.abs(value) >= min_odds)
        odds.append(F.when(counts_for, value).otherwise(0.0).alias(f"w_{t}"))
    kept = counts.select("feature", *odds).filter(" OR ".join(f"w_{t} <> 0" for t in TARGETS)).orderBy("feature").toPandas()
    return kept["feature"].to_numpy(np.int64), kept[[f"w_{t}" for t in TARGETS]].to_numpy(np.float64)


def evidence(
    df: DataFrame, hashes: np.ndarray, weights: np.ndarray, id_col: str, text_col: str, host_col: str, path_col: str, limit: float = 20.0
) -> DataFrame:
    """doc_id, host, path and a log likelihood ratio per target, written to the shared folder."""
    model = df.sparkSession.sparkContext.broadcast((hashes, weights))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, odds = model.value
        for b in batches:
            sums = np.zeros((b.num_rows, len(TARGETS)))
            for i, text in enumerate(byte_texts(b.column(3))):
                if len(known) and text:
                    f = features(text)
                    at = np.minimum(np.searchsorted(known, f), len(known) - 1)
                    sums[i] = odds[at[known[at] == f]].sum(axis=0)
            sums = np.clip(sums, -limit, limit)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), *[pa.array(sums[:, i]) for i in range(len(TARGETS))]],
                names=["doc_id", "host", "path", *[f"llr_{t}" for t in TARGETS]],
            )

    rows = df.select(
        df[id_col].cast("long").alias("doc_id"), df[host_col].cast("string").alias("host"),
        df[path_col].cast("string").alias("path"), df[text_col].alias("text"),
    )
    return landed(map_batches(rows, run, "doc_id long, host string, path string, " + ", ".join(f"llr_{t} double" for t in TARGETS)), "evidence")


def logit(p: Column) -> Column:
    p = F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), p))
    return F.log(p / (1 - p))


def chance(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def strength(groups: DataFrame, mean: str, parent: Column, n: str) -> float:
    """Strength of the prior of site means around their parents' mean, in documents, by moments."""
    inner = parent * (1 - parent)
    row = groups.agg(
        F.sum(F.col(n) * F.pow(F.col(mean) - parent, 2)).alias("spread"), F.sum(inner).alias("noise"),
        F.sum(F.col(n) * inner).alias("weighted"), F.sum(n).alias("n"),
    ).first()
    if not row["n"] or not row["weighted"]:
        return 1.0
    between = max(0.0, row["spread"] - row["noise"]) / row["n"]
    inside = row["weighted"] / row["n"]
    return float(min(1e6, max(1.0, inside / between - 1))) if between > 0 else 1e6


def classify(
    df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    max_labelled: int = 100_000, min_evidence: float = 30.0, min_odds: float = 2.0, min_quality: float = 0.5, max_toxic: float = 0.5,
) -> DataFrame:
    """doc_id, host, path, and per target the evidence (llr), the host's and the path's posterior mean and the document's
    probability; kept if the text is probably good and not toxic."""
    known = landed(one_per_id(labels, id_col), "labels")
    sample = landed(labelled_sample(known, max_labelled), "labelled")
    hashes, weights = fit(df, sample, id_col, text_col, min_evidence, min_odds)
    docs = evidence(df, hashes, weights, id_col, text_col, host_col, path_col)
    rates = [0.5 if r is None else min(1 - EDGE, max(EDGE, r)) for r in known.agg(*[F.avg(t) for t in TARGETS]).first()]
    # A label says what a document is; the others are judged by their evidence and the global rate.
    docs = docs.join(known, docs["doc_id"] == known["_id"], "left").drop("_id")
    for t, rate in zip(TARGETS, rates):
        docs = docs.withColumn(f"own_{t}", F.coalesce(F.col(t).cast("double"), chance(F.col(f"llr_{t}") + logit(F.lit(rate)))))
    paths = docs.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"own_{t}").alias(f"sum_{t}") for t in TARGETS])
    paths = landed(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(f"sum_{t}").alias(f"host_sum_{t}") for t in TARGETS])
    total = hosts.agg(F.sum("host_n").alias("n"), *[F.sum(f"host_sum_{t}").alias(t) for t in TARGETS]).first()
    for t in TARGETS:
        mean = F.lit(float(total[t] / total["n"]) if total["n"] else 0.5)
        k = strength(hosts.withColumn("_m", F.col(f"host_sum_{t}") / F.col("host_n")), "_m", mean, "host_n")
        hosts = hosts.withColumn(f"host_{t}", (F.col(f"host_sum_{t}") + k * mean) / (F.col("host_n") + k))
    sites = paths.join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    strengths = [strength(sites.withColumn("_m", F.col(f"sum_{t}") / F.col("n")), "_m", F.col(f"host_{t}"), "n") for t in TARGETS]
    sites = sites.select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), "n", *[f"{a}_{t}" for t in TARGETS for a in ("sum", "host")],
    )
    rows = docs.join(sites, docs["host"].eqNullSafe(F.col("_host")) & docs["path"].eqNullSafe(F.col("_path")))
    for t, k in zip(TARGETS, strengths):
        rows = rows.withColumn(f"path_{t}", (F.col(f"sum_{t}") + k * F.col(f"host_{t}")) / (F.col("n") + k))
        others = (F.col(f"sum_{t}") - F.col(f"own_{t}") + k * F.col(f"host_{t}")) / (F.col("n") - 1 + k)
        rows = rows.withColumn(f"p_{t}", chance(F.col(f"llr_{t}") + logit(others)))
    return rows.select(
        "doc_id", "host", "path", *[f"{a}_{t}" for t in TARGETS for a in ("llr", "host", "path", "p")],
        ((F.col("p_quality") >= min_quality) & (F.col("p_toxic") < max_toxic)).alias("kept"),
    )


def labels_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")
