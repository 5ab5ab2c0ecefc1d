"""Whether a fitted model is the one its training rows call for.

A fitted model has no SQL form, but what it optimises can be recomputed from the rows: the gradient of a penalised
loss, the loss around a support vector machine, the splits of a tree.  Every check is one pass over the weighted
distinct vectors; a task sends sums whose number depends on the model alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRADIENT, LOSS, COUNTS = 1e-5, 2e-3, 1e-6
STEPS = (0.01, 0.1, 1.0)


def _sums(model: PipelineModel, vectors: DataFrame, function: Callable, more: tuple[str, ...] = ()) -> np.ndarray:
    """Sums over all vectors of ``function(features, labels, weights, ...)``, a flat array of fixed length."""
    rows = PipelineModel(model.stages[:-1]).transform(vectors).select(vector_to_array("features").alias("x"), "label", "weight", *more)

    def run(batches):
        import pandas as pd

        total = None
        for b in batches:
            if len(b):
                part = function(np.stack(b["x"].to_list()), b["label"].to_numpy(dtype=float), b["weight"].to_numpy(dtype=float), *[b[c] for c in more])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"place": np.arange(len(total)), "value": total})

    found = rows.mapInPandas(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(found))
    for place, value in found:
        out[place] = value
    return out


def logistic_gradient(model: PipelineModel, vectors: DataFrame) -> float:
    """The largest entry of the gradient of the penalised mean log loss."""
    fitted = model.stages[-1]
    beta, bias, penalty = fitted.coefficients.toArray(), fitted.intercept, fitted.getRegParam()

    def part(x, y, w):
        error = w * (1 / (1 + np.exp(-(x @ beta + bias))) - y)
        return np.concatenate((error @ x, [error.sum(), w.sum()]))

    sums = _sums(model, vectors, part)
    if not len(sums):
        return float("inf")
    gradient = sums[:-1] / sums[-1]
    gradient[:-1] += penalty * beta
    return float(np.abs(gradient).max())


def hinge_improvement(model: PipelineModel, vectors: DataFrame) -> float:
    """How much of the penalised mean hinge loss a step along one axis, or a change of scale, would save at most."""
    fitted = model.stages[-1]
    beta, bias, penalty = fitted.coefficients.toArray(), fitted.intercept, fitted.getRegParam()
    d = len(beta)
    # Columns: nothing, every coefficient and the bias by every step up and down, the whole by a factor.
    moves = [np.zeros(d + 1)] + [sign * step * np.eye(d + 1)[j] for j in range(d + 1) for step in STEPS for sign in (1, -1)]
    moves += [f * np.append(beta, bias) for f in (-0.1, -0.01, 0.01, 0.1)]
    points = np.append(beta, bias) + np.array(moves)

    def part(x, y, w):
        margins = (x @ points[:, :-1].T + points[:, -1]) * (2 * y - 1)[:, None]
        return np.append(w @ np.maximum(0, 1 - margins), w.sum())

    sums = _sums(model, vectors, part)
    if not len(sums):
        return float("inf")
    losses = sums[:-1] / sums[-1] + penalty / 2 * (points[:, :-1] ** 2).sum(axis=1)
    return float((losses[0] - losses.min()) / max(losses[0], 1e-9))


@dataclass(frozen=True)
class Tree:
    """A fitted tree as arrays; node 0 is the root, ``left`` is -1 at leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    counts: np.ndarray  # what the model says about the weights of its classes
    prediction: np.ndarray

    @staticmethod
    def of(java_tree) -> Tree:
        rows: list[list] = []

        def add(node, depth: int) -> int:
            at = len(rows)
            rows.append([0, 0.0, -1, -1, depth, list(node.impurityStats().stats()), node.prediction()])
            if node.subtreeDepth():
                split = node.split()
                rows[at][:2] = split.featureIndex(), split.threshold()
                rows[at][2] = add(node.leftChild(), depth + 1)
                rows[at][3] = add(node.rightChild(), depth + 1)
            return at

        add(java_tree.rootNode(), 0)
        f, t, a, b, d, c, p = zip(*rows)
        return Tree(np.array(f), np.array(t), np.array(a), np.array(b), np.array(d), np.array(c, dtype=float), np.array(p))

    def members(self, x: np.ndarray) -> np.ndarray:
        """[node, row]: whether the row passes the node."""
        inside = np.zeros((len(self.left), len(x)), dtype=bool)
        inside[0] = True
        for n in np.flatnonzero(self.left >= 0):  # parents come before their children
            low = x[:, self.feature[n]] <= self.threshold[n]
            inside[self.left[n]], inside[self.right[n]] = inside[n] & low, inside[n] & ~low
        return inside


def _gini(counts: np.ndarray) -> np.ndarray:
    """Weighted impurity of class weights in the last axis."""
    total = counts.sum(axis=-1)
    return total - (counts**2).sum(axis=-1) / np.maximum(total, 1e-12)


def tree_fits(model: PipelineModel, vectors: DataFrame) -> bool:
    """Whether the nodes hold the weights they say, predict their larger class, and split as well as any candidate:
    each flag, and each threshold of a number that the tree uses anywhere."""
    fitted = model.stages[-1]
    tree = Tree.of(fitted._java_obj)
    inner = np.flatnonzero(tree.left >= 0)
    pairs = sorted({(int(f), 0.5) for f in range(fitted.numFeatures)} | {(int(tree.feature[n]), float(tree.threshold[n])) for n in inner})
    feature, threshold = (np.array(x) for x in zip(*pairs))
    shape = (len(tree.left), len(pairs) + 1, 2)

    def part(x, y, w):
        per_class = np.stack((w * (1 - y), w * y), axis=1)
        low = np.concatenate((x[:, feature] <= threshold, np.ones((len(x), 1), dtype=bool)), axis=1).astype(float)
        return np.concatenate([(low * m[:, None]).T @ per_class for m in tree.members(x)]).ravel()

    sums = _sums(model, vectors, part)
    if not len(sums):
        return False
    below = sums.reshape(shape)
    whole, low = below[:, -1], below[:, :-1]
    gain = _gini(whole)[:, None] - _gini(low) - _gini(whole[:, None] - low)
    best = gain.max(axis=1)
    slack = COUNTS * max(1.0, whole[0].sum())
    leaves = np.flatnonzero(tree.left < 0)
    said = np.abs(tree.counts - whole).max() <= slack
    right = all(whole[n, int(tree.prediction[n])] >= whole[n].max() - slack for n in leaves)
    chosen = np.array([pairs.index((int(tree.feature[n]), float(tree.threshold[n]))) for n in inner], dtype=int)
    splits = bool((gain[inner, chosen] >= best[inner] - slack).all())

    def may_end(n: int) -> bool:
        """A leaf ends at full depth, without gain, or where the best split predicts its class on both sides (such leaves are merged)."""
        if tree.depth[n] >= fitted.getMaxDepth() or best[n] <= slack:
            return True
        label = int(tree.prediction[n])
        for c in np.flatnonzero(gain[n] >= best[n] - slack):
            sides = low[n, c], whole[n] - low[n, c]
            if all(side[label] >= side.max() - slack for side in sides):
                return True
        return False

    return bool(said and right and splits and all(map(may_end, leaves.tolist())))


def forest_fits(model: PipelineModel, vectors: DataFrame, tree_model: PipelineModel) -> bool:
    """Whether the trees hold the weights of their bootstrap samples (column ``draws``), differ, and explain the rows: their
    mean impurity lies below that of the root, and not below that of a single tree that chooses among all features."""
    forest = [Tree.of(t) for t in model.stages[-1]._java_obj.trees()]
    single = Tree.of(tree_model.stages[-1]._java_obj)

    def part(x, y, w, draws):
        draws, out = np.stack(draws.to_list()), []
        for i, tree in enumerate([*forest, single]):
            inside = tree.members(x).astype(float)
            weights = draws[:, i] if i < len(forest) else w
            for v in (weights, w):
                out.append((inside @ np.stack((v * (1 - y), v * y), axis=1)).ravel())
        return np.concatenate(out)

    sums = _sums(model, vectors, part, ("draws",))
    if not len(sums):
        return False
    said, left, at = True, [], 0
    for tree in [*forest, single]:
        size, found = tree.counts.size, []
        for _ in range(2):
            found.append(sums[at : at + size].reshape(tree.counts.shape))
            at += size
        said &= np.abs(tree.counts - found[0]).max() <= COUNTS * max(1.0, found[0][0].sum())
        left.append(_gini(found[1][tree.left < 0]).sum())
    root = _gini(found[1][0])
    differ = len({t.counts.tobytes() for t in forest}) > len(forest) // 2
    mean, slack = np.mean(left[:-1]), COUNTS * max(1.0, root)
    return bool(said and differ and (mean < root - slack or root <= slack) and mean >= left[-1] - 0.05 * root)
