"""Toxicity by compression distance: two zstandard dictionaries compete for every window of a text.

One dictionary is trained on windows of ordinary documents, the other on passages of toxic ones. Labels are of whole
documents, most of whose text is like any other: so the toxic dictionary is trained on the passages around the words
that set toxic documents apart. How many bytes fewer a window takes with both dictionaries than with the ordinary one
alone is its distance, and a calibration on documents that neither dictionary has seen turns distances to a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import remainder, take_turn
from tessera.llm.labelled import fit_logistic, labelled_sample, sigmoid

WINDOW, LEVEL = 64, 3
#: Sizes of the dictionaries in bytes, and how many bytes on either side of a word its passage has.
ORDINARY_BYTES, TOXIC_BYTES, BESIDE = 4096, 1536, 2
#: Windows of the sample that a dictionary is trained on at most, taken at even steps.
MOST_WINDOWS = 120_000
#: A word beginning sets toxic documents apart if this share of toxic documents has it, and so many times the share of ordinary ones.
SHARE, LIFT = 0.03, 25
#: The bound of the training sample: documents of either label (see labelled_sample() for that of their characters).
PER_CLASS = 2500


def fold(text: str) -> bytes:
    return text.lower().encode()


def windows(data: bytes) -> Iterator[bytes]:
    """Windows that overlap by half and cover the text."""
    for at in range(0, max(1, len(data) - WINDOW // 2), WINDOW // 2):
        yield data[at : at + WINDOW]


@dataclass
class Distance:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(10))
    empty: float = 0.0

    def __post_init__(self):
        self.pair = None

    def __getstate__(self):
        return self.__dict__ | {"pair": None}  # compressors are made anew where the model arrives

    def compressors(self):
        if self.pair is None:
            self.pair = tuple(zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False).compress for x in (self.ordinary, self.ordinary + self.toxic))
        return self.pair

    def features(self, text: str) -> list[float]:
        """How many bytes the toxic dictionary saves, over the windows of the whole text."""
        plain, both = self.compressors()
        saved = np.fromiter((len(plain(w)) - len(both(w)) for w in windows(fold(text))), np.int32)
        n = len(saved)
        top = np.sort(np.partition(saved, n - 3)[n - 3 :] if n > 3 else saved)
        return [top[-1], top.mean(), saved.mean(), *((saved >= k).mean() for k in (2, 3, 4)), *(np.log1p((saved >= k).sum()) for k in (3, 4, 5))]

    def score(self, text: str | None) -> float:
        if not text:
            return self.empty
        return float(sigmoid(np.dot(self.features(text), self.weights[:-1]) + self.weights[-1]))


def beginnings(text: str) -> set[bytes]:
    return {w[:n] for w in set(fold(text).split()) for n in range(4, min(8, len(w)) + 1)}


def passages(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Of each toxic text, once, the words whose beginning the ordinary texts hardly have, with a few bytes on either side."""
    one, other = Counter(g for t in toxic for g in beginnings(t)), Counter(g for t in ordinary for g in beginnings(t))
    share = lambda c, n: (c + 0.5) / (n + 1)
    apart = {g for g, c in one.items() if c >= max(3, SHARE * len(toxic)) and share(c, len(toxic)) > LIFT * share(other[g], len(ordinary))}
    found = []
    for data in map(fold, toxic):
        had: set[bytes] = set()
        for m in re.finditer(rb"\S+", data):
            own = next((g for n in range(4, 9) if (g := m.group()[:n]) in apart), None)
            if own is not None and own not in had:
                had.add(own)
                found.append(data[max(0, m.start() - BESIDE) : m.end() + BESIDE])
    return found


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, whole; of samples too few or too much alike to train on, their end."""
    samples = samples[:: -(-len(samples) // MOST_WINDOWS) or 1]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def train(texts: list[str], y: np.ndarray, weight: np.ndarray) -> Distance:
    """Dictionaries from two thirds of the sample, and the calibration of their distances from the rest."""
    base = float(np.average(y, weights=weight)) if len(y) else 0.0
    learn = [k for k in range(len(texts)) if k % 3]
    toxic, ordinary = [texts[k] for k in learn if y[k]], [texts[k] for k in learn if not y[k]]
    own = dictionary(passages(toxic, ordinary), TOXIC_BYTES)
    model = Distance(dictionary([w for t in ordinary for w in windows(fold(t))], ORDINARY_BYTES) or b" " * 8, own, empty=base)
    rest = [k for k in range(len(texts)) if k % 3 == 0 and texts[k]]
    if not own or len(set(y[rest])) < 2:
        rest = [k for k in range(len(texts)) if texts[k]]
    if rest:
        model.weights = fit_logistic(np.array([model.features(texts[k]) for k in rest], float), y[rest], weight[rest])
    return model


def trained(docs: DataFrame, labels: DataFrame, by: int = 4, held: int = 2, per_class: int = PER_CLASS, **bounds) -> Distance:
    return train(*labelled_sample(docs, labels, "toxic", by, held, per_class, **bounds))


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **sample) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, over the whole text.

    Null and empty texts get the share of label 1 in training, without labels 0; a score of just `threshold` is
    predicted 1. A null doc_id was held out. Repeated rows are scored each; other columns aren't read; no rows give none.
    """
    model = trained(docs, labels, **sample)
    by, held = sample.get("by", 4), sample.get("held", 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("toxicity")
        for batch in batches:
            found = np.fromiter((model.score(x.as_py()) for x in batch.column(1)), float, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")
    rest = F.coalesce(remainder(F.col("doc_id"), by) == held, F.lit(True)).alias("held_out")
    return scored.select("doc_id", rest, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
