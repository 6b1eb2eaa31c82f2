"""SimHash fingerprints, and near-duplicate groups found with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import take_turn, written
from tessera.llm.components import components

BITS = 64
#: Shingles that are hashed at once.
BLOCK = 1 << 16
#: Members of a bucket up to which its pairs are looked at. Beyond it a member costs fewer rows by its own
#: neighbourhood (1 + 64 + 2016) than by its share of the pairs in the 20 tables.
PAIRED = 256


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of a text: of the hashes of its word shingles, the bits set in over half."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    total, votes = len(words) - shingle + 1, np.zeros(BITS, np.int64)
    for at in range(0, total, BLOCK):
        part = words[at : at + BLOCK + shingle - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64)
        votes += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > total).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The unsigned number of the bits that are set in over half of some hashes."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        votes += np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the fingerprint's bits as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("simhash")
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def pivots(n: int, seed: int = 42) -> list[int]:
    """Reference fingerprints, as signed numbers."""
    return [int(np.uint64(xxhash.xxh64_intdigest(f"pivot {k}", seed)).view(np.int64)) for k in range(n)]


def distance_table(fp: Column, n: int) -> list[Column]:
    """Distances of a fingerprint to `n` pivots, eight in a bigint, a byte each."""
    each = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("bigint") for p in pivots(n)]
    packed = []
    for at in range(0, n, 8):
        lot = each[at : at + 8]
        value = lot[0]
        for k, x in enumerate(lot[1:], 1):
            value = value.bitwiseOR(F.shiftleft(x, 8 * k))
        packed.append(value.alias(f"d{at // 8}"))
    return packed


def within(n: int, most: int) -> Column:
    """Whether the tables of sides x and y differ by `most` at most in every coordinate."""
    ok = F.lit(True)
    for k in range(n):
        x, y = (F.shiftright(F.col(f"{side}.d{k // 8}"), 8 * (k % 8)).bitwiseAND(F.lit(127)) for side in "xy")
        ok = ok & (F.abs(x - y) <= most)
    return ok


def block_masks(most: int) -> list[int]:
    """Masks such that any two fingerprints at `most` bits or fewer agree under at least one.

    The bits are cut into 2 * most blocks; `most` differing bits leave `most` blocks alone.
    """
    edges = np.linspace(0, BITS, 2 * most + 1).round().astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges, edges[1:], strict=False)]
    return [int(np.uint64(sum(x)).view(np.int64)) for x in combinations(blocks, most)]


def links(nodes: DataFrame, most: int = 3, n_pivots: int = 16, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within `most` bits; nodes: (rep, fp), one row a fingerprint.

    Pairs are drawn only within buckets, of fingerprints that agree under one of the block masks. The pivot tables
    discard pairs by their largest coordinate difference and the survivors' distance is verified. A bucket of more
    than `paired` fingerprints, as a large group of near copies makes, isn't paired: see crowded().
    """
    keyed = nodes.select("rep", "fp", *distance_table(F.col("fp"), n_pivots), F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(most)))).alias("t", "k"))
    size = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = written(keyed.join(size, ["t", "k"]), "simhash-buckets")
    few, many = sized.where(F.col("n") <= paired), sized.where(F.col("n") > paired).select("rep", "fp").distinct()
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.rep") < F.col("y.rep")) & within(n_pivots, most))
    near = pairs.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= most).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    return near.union(crowded(many, most)).distinct()


def crowded(nodes: DataFrame, most: int) -> DataFrame:
    """Edges that connect `nodes` within `most` bits, without pairs: as many rows a node for a group of any size.

    A node goes to every fingerprint z at distance most // 2 (near) and (most + 1) // 2 (far) or less from it. Two
    nodes are within `most` bits if and only if some z has one of them near and the other far; so all nodes that
    meet at a z with a near one are linked to the least near one, and meeting there is a link in itself.
    """
    near, far = most // 2, (most + 1) // 2
    level = nodes.select("rep", F.col("fp").alias("z"), F.lit(-1).alias("bit"))
    met = level.select("rep", "z", F.lit(0).alias("w"))
    for w in range(1, far + 1):
        level = level.where(F.col("bit") < BITS - 1).select("rep", "z", F.explode(F.sequence(F.col("bit") + 1, F.lit(BITS - 1))).alias("bit"))
        level = level.select("rep", F.col("z").bitwiseXOR(F.expr("shiftleft(1L, bit)")).alias("z"), "bit")
        met = met.union(level.select("rep", "z", F.lit(w).alias("w")))
    hub = met.groupBy("z").agg(F.min(F.when(F.col("w") <= near, F.col("rep"))).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1 and hub is not null").select("z", "hub")
    return met.join(hub, "z").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, most: int = 3, shingle: int = 3, seed: int = 42, n_pivots: int = 16, paired: int = PAIRED) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Rows of one fingerprint are one node, named by the smallest doc_id, so exact copies cost nothing more. A text
    without words (null too) has fingerprint zero and links like any other. Rows with a null doc_id get their
    fingerprint's component if another row has that fingerprint with an id, else null. Repeated rows stay.
    """
    prints = written(fingerprints(docs, shingle, seed), "simhash-prints")
    nodes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    nodes = written(nodes, "simhash-nodes")
    found = components(links(nodes, most, n_pivots, paired))
    named = nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
