"""Bounded training samples, and the logistic fits that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import remainder


#: Characters of all texts of a sample together, and of one text: a longer one is not drawn.
MOST_CHARS, LONGEST = 24_000_000, 2_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, by: int, held: int, per_class: int, most_chars: int = MOST_CHARS, longest: int = LONGEST) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Whole texts, labels and weights of a bounded sample of the labelled documents with crc32(doc_id) mod `by` other than `held`.

    Rows are drawn by a hash of the id: at most `per_class` documents of either label, none with a text of more than
    `longest` characters, and no more once `most_chars` are together; that is what reaches the driver. Texts are never
    cut. Weights restore the share that each label has among all training labels. Labels other than 0 and 1, null ids
    and ids with both labels teach nothing. Of several rows with one id the first by their text's hash teaches. Texts
    come back in the order of the hash; no labelled document gives empty lists.
    """
    known = labels.select(F.col("doc_id").cast("bigint"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder(F.col("doc_id"), by) != held))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("doc_id", "y")
    order = F.xxhash64("doc_id", F.lit(label))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("bigint"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
    sizes = found.select("doc_id", "y", F.length("text").alias("size"), F.xxhash64("text").alias("key"), order.alias("place")).where(F.col("size") <= longest)
    sizes = sizes.groupBy("doc_id", "y", "place").agg(F.min(F.struct("key", "size")).alias("first")).select("doc_id", "y", "place", "first.key", "first.size")
    drawn, total = [], 0
    for r in sizes.orderBy("place", "doc_id").limit(2 * per_class).collect():
        total += r["size"]
        if total > most_chars and drawn:
            break
        drawn.append((r["doc_id"], r["key"], len(drawn)))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    if drawn:
        ids = F.broadcast(docs.sparkSession.createDataFrame(drawn, "doc_id bigint, key bigint, place int"))
        texts = found.withColumn("key", F.xxhash64("text")).join(ids, ["doc_id", "key"]).dropDuplicates(["place"])
        rows = sorted(texts.select("place", "text", "y").collect())
    y = np.array([r["y"] for r in rows], float)
    weight = np.ones(len(y))
    for k in (0, 1):
        if (y == k).any():
            weight[y == k] = counts[k] / (y == k).sum()
    return [r["text"] for r in rows], y, weight / weight.mean() if len(y) else weight


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights, the intercept last, by Newton's method on columns that are scaled inside."""
    if not len(y):
        return np.zeros(x.shape[1] + 1)
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z, w = np.c_[(x - mean) / sd, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    own = np.r_[np.full(x.shape[1], ridge), 1e-3]
    for _ in range(steps):
        p = sigmoid(z @ w)
        w = w + np.linalg.solve(z.T @ (z * (weight * p * (1 - p) + 1e-9)[:, None]) + np.diag(own), z.T @ (weight * (y - p)) - own * w)
    out = w.copy()
    out[:-1] /= sd
    out[-1] -= (w[:-1] * mean / sd).sum()
    return out
