"""Listwise learning to rank: boosted trees on lambda gradients, grown from histograms.

A round takes the gradients of NDCG at TOP within each query, then grows one tree level by
level: Spark adds up gradients by (node, feature, bin), and the driver, which sees only those
sums, picks the splits. Trees are column expressions over the features, so scoring stays in the
plan. Training stops when NDCG on held-out queries has not risen for `patience` rounds, and the
model keeps the trees up to the best round.

The gradient of a pair is zero if both are ranked below TOP, so a query of n documents has
TOP * n pairs at most; a query is one group of a task and should be a list of candidates, not a
corpus. Ties of scores rank by doc_id. Null features count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import fresh_folder, removed, stored

TOP, BINS = 10, 32


def lambdas(labels: np.ndarray, scores: np.ndarray, order: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients, second derivatives and NDCG of one query; order breaks ties of scores.

    A pair of labels counts by the change of NDCG that swapping the two would make, times the
    logistic loss of their scores. Without any gain NDCG is 1 and nothing is to be learnt.
    """
    n = len(labels)
    gain = np.exp2(labels.astype(float)) - 1
    at = np.lexsort((order, -scores))
    discount = np.zeros(n)
    discount[at[:top]] = 1 / np.log2(np.arange(2, min(top, n) + 2))
    ideal = (np.sort(gain)[::-1][:top] / np.log2(np.arange(2, min(top, n) + 2))).sum()
    grad, second = np.zeros(n), np.zeros(n)
    if ideal <= 0:
        return grad, second, 1.0
    place = np.empty(n, np.int64)
    place[at] = np.arange(n)
    for i in at[:top]:
        other = np.flatnonzero((labels != labels[i]) & ((place > place[i]) | (place >= top)))
        sign = np.sign(labels[i] - labels[other]).astype(float)
        swap = np.abs((gain[i] - gain[other]) * (discount[i] - discount[other])) / ideal
        miss = 1 / (1 + np.exp(np.clip(sign * (scores[i] - scores[other]), -50, 50)))
        push, bend = swap * miss * sign, swap * miss * (1 - miss)
        grad[i] += push.sum()
        second[i] += bend.sum()
        grad[other] -= push
        second[other] += bend
    return grad, second, float((gain * discount).sum() / ideal)


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    bin: int = -1
    children: list[Node] = field(default_factory=list)


@dataclass
class LambdaModel:
    """Trees over binned features; transform adds the score as `prediction`."""

    features: list[str]
    edges: list[list[float]]
    trees: list[Node] = field(default_factory=list)
    ndcg: float = 0.0

    def binned(self) -> Column:
        """The bin of each feature: how many edges are below its value."""
        value = lambda f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))
        return F.array(*(sum((F.when(value(f) > e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int") for f, edges in zip(self.features, self.edges, strict=True)))

    def tree(self, node: Node, bins: str = "bins") -> Column:
        if not node.children:
            return F.lit(float(node.value))
        return F.when(F.get(F.col(bins), F.lit(node.feature)) <= node.bin, self.tree(node.children[0], bins)).otherwise(self.tree(node.children[1], bins))

    def transform(self, rows: DataFrame) -> DataFrame:
        scored = rows.withColumn("_bins", self.binned())
        return scored.withColumn("prediction", sum((self.tree(t, "_bins") for t in self.trees), F.lit(0.0))).drop("_bins")


def quantile_edges(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """At most bins - 1 edges of each feature, between values of the table."""
    shares = [(k + 1) / bins for k in range(bins - 1)]
    cols = [F.percentile_approx(F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)), shares, 2000).alias(f) for f in features]
    found = rows.agg(*cols).first()
    return [sorted(set(found[f] or [])) for f in features]


def _gradients(rows: DataFrame) -> DataFrame:
    """rows (qid, doc_id, label, held, bins, score) with grad, second, and the query's ndcg in one of its rows."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in ("qid", "doc_id", "label", "held", "bins", "score")), "grad double, second double, ndcg double"])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        order = p["doc_id"].rank(method="first").to_numpy()
        grad, second, ndcg = lambdas(p["label"].to_numpy(float), p["score"].to_numpy(float), order)
        return p.assign(grad=grad, second=second, ndcg=[ndcg, *[None] * (len(p) - 1)])[["qid", "doc_id", "label", "held", "bins", "score", "grad", "second", "ndcg"]]

    return rows.groupBy("qid").applyInPandas(run, schema)


def _leaves(node: Node) -> Iterator[Node]:
    if node.children:
        for c in node.children:
            yield from _leaves(c)
    else:
        yield node


def _numbered(node: Node, numbers: dict[int, int]) -> Column:
    if not node.children:
        return F.lit(numbers.get(id(node), -1))
    return F.when(F.get(F.col("bins"), F.lit(node.feature)) <= node.bin, _numbered(node.children[0], numbers)).otherwise(_numbered(node.children[1], numbers))


def grow(rows: DataFrame, n_features: int, *, depth: int, rate: float, ridge: float, least: int) -> Node:
    """A tree over rows (bins, grad, second): leaves are rate * sum(grad) / (sum(second) + ridge)."""
    root = Node()
    open_ = [root]
    for level in range(depth):
        numbers = {id(n): k for k, n in enumerate(open_)}
        dealt = rows.select(_numbered(root, numbers).alias("node"), F.posexplode("bins").alias("feature", "bin"), "grad", "second").where("node >= 0")
        sums = dealt.groupBy("node", "feature", "bin").agg(F.sum("grad").alias("g"), F.sum("second").alias("h"), F.count(F.lit(1)).alias("n"))
        table = sums.toPandas()  # nodes x features x bins rows at most
        fresh = []
        for k, node in enumerate(open_):
            own = table[table["node"] == k]
            hist = np.zeros((n_features, BINS, 3))
            hist[own["feature"].to_numpy(int), own["bin"].to_numpy(int)] = own[["g", "h", "n"]].to_numpy(float)
            g, h, n = hist[0].sum(axis=0)
            node.value = rate * g / (h + ridge)
            left = hist.cumsum(axis=1)[:, :-1]
            right = np.array([g, h, n]) - left
            better = left[..., 0] ** 2 / (left[..., 1] + ridge) + right[..., 0] ** 2 / (right[..., 1] + ridge) - g**2 / (h + ridge)
            better = np.where((left[..., 2] >= least) & (right[..., 2] >= least), better, -1.0)
            f, b = divmod(int(np.argmax(better)), BINS - 1)
            if better[f, b] > 1e-12:
                node.feature, node.bin = f, b
                node.children = [Node(rate * s[f, b, 0] / (s[f, b, 1] + ridge)) for s in (left, right)]
                fresh += node.children
        open_ = fresh
        if not open_:
            break
    return root


def train_listwise(
    features: DataFrame,
    names: list[str],
    *,
    label: str = "label",
    rounds: int = 40,
    depth: int = 3,
    rate: float = 0.3,
    ridge: float = 0.1,
    least: int = 2,
    patience: int = 8,
    held_out: float = 0.2,
) -> tuple[LambdaModel, float]:
    """A model of features (qid, doc_id, names, label), and its NDCG at TOP on held-out queries.

    Queries are dealt by a hash of qid; if all or none are held out, all of them serve as both.
    """
    model = LambdaModel(list(names), quantile_edges(features, list(names)))
    held = F.pmod(F.xxhash64("qid"), F.lit(100)) < int(held_out * 100)
    rows = stored(features.select("qid", "doc_id", F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("label"), held.alias("held"), model.binned().alias("bins"), F.lit(0.0).alias("score")))
    n_held, n = rows.where("held").count(), rows.count()
    if n_held in (0, n):
        fit = test = F.lit(True)
    else:
        fit, test = ~F.col("held"), F.col("held")
    best, best_at, before = -1.0, 0, None
    for turn in range(rounds + 1):
        folder = fresh_folder(rows.sparkSession, "gradients")
        made = stored(_gradients(rows), folder)
        ndcg = made.where(test).agg(F.avg("ndcg")).first()[0] or 0.0
        if before:
            removed(rows.sparkSession, before)
        before = folder
        if ndcg > best + 1e-9:
            best, best_at = ndcg, turn
        if turn == rounds or turn - best_at >= patience:
            break
        tree = grow(made.where(fit), len(names), depth=depth, rate=rate, ridge=ridge, least=least)
        if not tree.children:
            break
        model.trees.append(tree)
        rows = made.select("qid", "doc_id", "label", "held", "bins", (F.col("score") + model.tree(tree)).alias("score"))
    removed(rows.sparkSession, before)
    model.trees, model.ndcg = model.trees[:best_at], best
    return model, best


def tune(features: DataFrame, names: list[str], *, settings: tuple[dict, ...] = ({"depth": 3}, {"depth": 4}, {"depth": 3, "rate": 0.1}), **fixed: object) -> tuple[LambdaModel, float]:
    """The model of the setting with the best held-out NDCG, of equal ones the first."""
    found = [train_listwise(features, names, **{**fixed, **s}) for s in settings]
    return max(found, key=lambda x: x[1])
