"""A byte-level convolutional network that scores the quality of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fewer_rows, free, remainder, take_turn
from tessera.llm.labelled import fit_logistic, labelled_sample, sigmoid

WIDTH, STEP, DIM, FILTERS, HIDDEN = 12, 4, 8, 32, 16
#: A block is 64 filter positions, 256 bytes; a chunk is two blocks, and each block but the first and last is in two chunks.
POSITIONS = 64
BLOCK = POSITIONS * STEP
#: Bytes of a document that are filtered at once.
SLAB = BLOCK * 256
#: The bound of the training sample: documents of either label (see labelled_sample() for that of their characters).
PER_CLASS = 2000
#: Batches of the fit at most: a bound on the driver's time, which every chunk of the sample shares evenly.
MOST_STEPS = 3000


@dataclass
class Network:
    embedding: np.ndarray  # (256, DIM); byte 0, which also pads, is zero
    filters: np.ndarray  # (WIDTH * DIM, FILTERS)
    bias: np.ndarray
    hidden: np.ndarray  # (FILTERS, HIDDEN)
    hidden_bias: np.ndarray
    out: np.ndarray  # (HIDDEN + 1,)
    combine: np.ndarray  # weights of the chunks' mean and least logit, and the intercept
    empty: float  # score of a text without bytes

    def blocks(self, data: bytes) -> np.ndarray:
        """Filter responses, max-pooled by block; a slab at a time, each with the bytes its last windows reach into."""
        found = []
        for at in range(0, len(data), SLAB):
            part = data[at : at + SLAB + WIDTH - STEP]
            n = -(-min(SLAB, len(data) - at) // BLOCK)
            raw = np.zeros(n * BLOCK + WIDTH - STEP, np.uint8)
            raw[: len(part)] = np.frombuffer(part, np.uint8)[: len(raw)]
            found.append(self.pooled(windows(self.embedding[raw])).reshape(n, POSITIONS, FILTERS).max(1))
        return np.concatenate(found)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.filters + self.bias, 0)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled @ self.hidden + self.hidden_bias, 0) @ self.out[:-1] + self.out[-1]

    def summary(self, text: str) -> tuple[float, float]:
        """Mean and least chunk logit."""
        blocks = self.blocks(text.encode())
        chunks = np.maximum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks
        found = self.logits(chunks)
        return float(found.mean()), float(found.min())

    def score(self, text: str | None) -> float:
        if not text:
            return self.empty
        return float(sigmoid(np.dot(self.summary(text), self.combine[:2]) + self.combine[2]))


def windows(embedded: np.ndarray) -> np.ndarray:
    """Overlapping windows of WIDTH bytes, STEP apart, as rows."""
    flat = np.ascontiguousarray(embedded).reshape(-1)
    n = (len(embedded) - WIDTH) // STEP + 1
    return np.lib.stride_tricks.as_strided(flat, (n, WIDTH * DIM), (STEP * DIM * flat.itemsize, flat.itemsize))


def train(texts: list[str], y: np.ndarray, weight: np.ndarray, epochs: int = 6, seed: int = 7, rate: float = 3e-3) -> Network:
    """Fits filters, embedding and the layers above on chunks that bear their document's label, then the combination
    of chunk logits on documents. Balanced batches by Adam; a max-pooled response sends its gradient to one window."""
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, scale: rng.normal(0, scale, shape).astype("float32")
    net = Network(f32(256, DIM, scale=0.5), f32(WIDTH * DIM, FILTERS, scale=(WIDTH * DIM) ** -0.5), np.zeros(FILTERS, "float32"), f32(FILTERS, HIDDEN, scale=FILTERS**-0.5), np.zeros(HIDDEN, "float32"), f32(HIDDEN + 1, scale=HIDDEN**-0.5), np.array([1.0, 0.0, 0.0]), float(np.average(y, weights=weight)) if len(y) else 0.5)
    net.embedding[0] = 0
    if len(set(y)) < 2:  # nothing to tell apart
        net.combine = np.array([0.0, 0.0, np.log((net.empty + 1e-3) / (1 - net.empty + 1e-3))])
        return net
    size = 2 * BLOCK + WIDTH - STEP
    rows, owner = [], []
    for k, text in enumerate(texts):
        data = text.encode()
        for at in range(0, max(1, len(data) - BLOCK), BLOCK):
            if part := data[at : at + size]:
                rows.append(np.frombuffer(part.ljust(size, b"\0"), np.uint8))
                owner.append(k)
    raw, label = np.stack(rows), y[owner].astype("float32")
    sides = [np.flatnonzero(label == k) for k in (0, 1)]
    params = ("embedding", "filters", "bias", "hidden", "hidden_bias", "out")
    moments = {p: [np.zeros_like(getattr(net, p)), np.zeros_like(getattr(net, p))] for p in params}
    half = 24
    steps = min(MOST_STEPS, max(60, epochs * len(rows) // (2 * half)))
    for step in range(1, steps + 1):
        own = np.concatenate([rng.choice(x, half) for x in sides])
        b, want = raw[own], label[own]
        x = np.stack([windows(e) for e in net.embedding[b]])
        act = x @ net.filters + net.bias
        best = act.argmax(1)
        h = np.maximum(np.take_along_axis(act, best[:, None], 1)[:, 0], 0)
        g = np.maximum(h @ net.hidden + net.hidden_bias, 0)
        d = (sigmoid(g @ net.out[:-1] + net.out[-1]) - want).astype("float32") / len(own)
        dg = np.outer(d, net.out[:-1]) * (g > 0)
        dh = (dg @ net.hidden.T) * (h > 0)
        won = x[np.arange(len(own))[:, None], best]  # (batch, filters, window)
        dw = dh[:, :, None] * net.filters.T[None]  # gradient of the winning windows
        into = np.zeros_like(net.embedding)
        reached = b[np.arange(len(own))[:, None, None], best[:, :, None] * STEP + np.arange(WIDTH)]
        np.add.at(into, reached.reshape(-1), dw.reshape(-1, DIM))
        into[0] = 0
        grads = {"embedding": into, "filters": np.einsum("bf,bfw->wf", dh, won), "bias": dh.sum(0), "hidden": h.T @ dg, "hidden_bias": dg.sum(0), "out": np.r_[g.T @ d, d.sum()].astype("float32")}
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, grad in grads.items():
            m, v = moments[p]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            getattr(net, p)[...] -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    have = [k for k, t in enumerate(texts) if t]
    seen = np.array([net.summary(texts[k]) for k in have])
    net.combine = fit_logistic(seen, y[have], weight[have])
    return net


def trained(docs: DataFrame, labels: DataFrame, by: int = 3, held: int = 1, per_class: int = PER_CLASS, **bounds) -> Network:
    return train(*labelled_sample(docs, labels, "quality", by, held, per_class, **bounds))


def score_quality(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every row; the whole text is read, in bytes. Null and empty texts have a score too: the
    share of label 1 in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("quality")
        for batch in batches:
            found = np.fromiter((net.score(x.as_py()) for x in batch.column(1)), float, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, **sample) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, over the whole text.

    Null and empty texts get the share of label 1 in training, without labels 0.5; a score of just 0.5 is predicted 1.
    A null doc_id was held out of training. Repeated rows are scored each; other columns aren't read; no rows give none.
    """
    net = trained(docs, labels, **sample)
    by, held = sample.get("by", 3), sample.get("held", 1)
    rest = F.coalesce(remainder(F.col("doc_id"), by) == held, F.lit(True)).alias("held_out")
    return score_quality(docs, net).select("doc_id", rest, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, **sample) -> DataFrame:
    """The rows of `docs` whose score is `least` or more, with their columns as they are, whatever they are called.

    Null and empty texts are scored like any other, by the share of label 1; a score of just `least` stays; repeated
    rows stay or go together; no rows give none; without labels every score is 0.5. Rows are scored when the result is
    read, so the session keeps the smaller batches to Python that this sets.
    """
    net = trained(docs, labels, **sample)
    fewer_rows(docs.sparkSession)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        take_turn("quality")
        for text in parts:
            yield text.map(net.score)

    names = list(docs.columns)
    own = free(names, "score")
    return docs.withColumn(own, score(F.col("text").cast("string"))).where(F.col(own) >= least).select(*(F.col(f"`{c}`") for c in names))
