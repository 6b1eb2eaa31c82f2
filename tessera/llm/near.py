"""Near-duplicates by Jaccard similarity of word shingles: SimHash with pivot tables finds most, prefixes every pair that is left, and
every link is verified."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import BLANK_CHARS, free, let_go, small, small_batches, take_turn, written
from tessera.llm.components import components

#: Texts are linked from a similarity of 4/5 of their sets of five-word shingles; exact, in whole numbers.
SHINGLE, SHARE, OF = 5, 4, 5
#: Parity bits of a shingle set, in 64-bit words.
SKETCH = 8
#: Documents that the order of shingles is learned from, and the shingles it keeps; the order decides on speed alone.
ORDER_DOCS, ORDER_KEYS = 25_000, 100_000
#: Shared shingles that a set is known by when a pair is told from one that has been met before.
EARLY = 16
#: Bits in which fingerprints that are held against each other differ at most, and pivots of their distance tables.
PRINT_BITS, PIVOTS = 3, 16
#: Members of a bucket that meet all others of one block at once.
BLOCK = 256
#: Rounds of stars end when one links less than this share of the members.
WORTH, MOST_ROUNDS = 0.01, 8
#: Rows whose shingle sets a worker holds at once, and characters of a text that are split at once.
HELD, LOT = 256, 1 << 18
BLANK_RUN = re.compile(r"[\x20\x09-\x0D]")
SKETCHES = [f"s{k}" for k in range(SKETCH)]


def word_lots(text: str | None, lot: int = LOT) -> Iterator[list[bytes]]:
    """The words of a text in lower case, some at a time; a word that is longer than `lot` characters is a lot with others."""
    text = text or ""
    at, n = 0, len(text)
    while at < n:
        cut = n if at + lot >= n else max(text.rfind(c, at, at + lot) for c in BLANK_CHARS) + 1
        if cut <= at:  # no white space in so many characters
            cut = next((m.end() for m in BLANK_RUN.finditer(text, at + lot)), n)
        yield text[at:cut].encode().lower().split()
        at = cut


def shingle_set(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text's words are one; no words, none. A long text is
    split some of it at a time."""
    found, before, total = [], [], 0
    for words in word_lots(text):
        total += len(words)
        words = before + words
        joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
        found.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64)))
        before = words[-(shingle - 1) :]
    if not total:
        return np.zeros(0, np.uint64)
    if total < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(before), seed)], np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def sketch(own: np.ndarray) -> np.ndarray:
    """Parity of the shingles at each bit: sets differ in at least as many shingles as their sketches in bits."""
    parity = np.bincount((own % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def wide_sketch(own: np.ndarray) -> bytes | None:
    """The parity sketch of a set that has more shingles than the short one has bits: as many bits as shingles or more, a
    power of two, so that sketches of two lengths can be brought to the lesser one."""
    if len(own) <= 64 * SKETCH:
        return None
    bits = 1 << int(len(own) - 1).bit_length()
    return np.packbits((np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def parted(x: bytes, y: bytes) -> int:
    """In how many bits two wide sketches differ; the longer one is folded to the length of the other."""
    one, two = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    short = min(len(one), len(two))
    one, two = (np.bitwise_xor.reduce(v.reshape(-1, short), axis=0) for v in (one, two))
    return int(np.bitwise_count(one ^ two).sum())


def prefix(own: np.ndarray, keys: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones before those of `keys` by level: two sets of a similarity of 4/5 or more
    have one in common in their prefixes, whatever the order is."""
    n = len(own)
    if len(keys) and n:
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        own = own[np.argsort(np.where(keys[at] == own, level[at], 0), kind="stable")]
    return own[: n - (SHARE * n + OF - 1) // OF + 1] if n else own


def row_key(docs: DataFrame) -> Column:
    """Rows are told apart by all of their columns, nulls included; maps, which have no hash, by how they print."""
    names = [F.col(f"`{c}`").cast("string") if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return F.xxhash64(*names, F.array(*(c.isNull() for c in names)))


def lists(found: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, HELD):
            yield batch.slice(at, HELD)


def shingle_order(docs: DataFrame, most_docs: int = ORDER_DOCS, most_keys: int = ORDER_KEYS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent among some documents, sorted, and how frequent each is in powers of two."""
    every = max(1, docs.count() // most_docs)
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select(F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("near")
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x.as_py()).view(np.int64))], ["key"])

    often = some.mapInArrow(run, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    rows = often.orderBy(F.desc("n"), "key").limit(most_keys).toArrow()
    keys, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], np.log2(np.maximum(n, 1)).astype(np.int8)[order]


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, row, node, n, fp, s0.., wide, prefix) of every row; rows with the same set of shingles are one node, fp is
    its SimHash fingerprint."""
    keys, level = shingle_order(docs)
    names = ["doc_id", "row", "node", "n", "fp", *SKETCHES, "wide", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("near")
        for batch in parts(batches):
            own = [shingle_set(x.as_py()) for x in batch.column(2)]
            node = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in own), np.uint64, len(own)).view(np.int64)
            fp = np.fromiter((simhash.majority(s) for s in own), np.uint64, len(own)).view(np.int64)
            bits = np.array([sketch(s) for s in own], np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), pa.array([len(s) for s in own], pa.int64()), pa.array(fp), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(SKETCH)), pa.array([wide_sketch(s) for s in own], pa.binary()), lists([prefix(s, keys, level) for s in own])], names)

    kinds = ", ".join(f"{c} bigint" for c in names[:-2]) + ", wide binary"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key(docs).alias("row"), F.col("text").cast("string")).mapInArrow(run, f"{kinds}, prefix array<bigint>")


def may_link(a: str, b: str) -> Column:
    """Whether sizes and sketches of sides a and b leave a similarity of 4/5 possible: the sets then differ in at most
    a ninth of the sum of their sizes."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))).cast("bigint") for c in SKETCHES), F.lit(0).cast("bigint"))
    return (OF * F.least(n, m) >= SHARE * F.greatest(n, m)) & ((SHARE + OF) * apart <= (OF - SHARE) * (n + m))


def plausible(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose wide sketches leave a similarity of 4/5 possible; pairs of small sets, whose short
    sketches have been compared, stay. A sketch has a bit or two for each shingle, a 32nd or less of the set."""
    side = nodes.select("node", "n", "wide")
    both = pairs.join(side.toDF("a", "n", "x"), "a").join(side.toDF("b", "m", "y"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("near")
        for batch in batches:
            a, b, sizes, x, y = (batch.column(k).to_pylist() for k in range(5))
            near = [k for k in range(len(a)) if x[k] is None or y[k] is None or (SHARE + OF) * parted(x[k], y[k]) <= (OF - SHARE) * sizes[k]]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in near], pa.int64()), pa.array([b[k] for k in near], pa.int64())], ["a", "b"])

    return both.select("a", "b", F.col("n") + F.col("m"), "x", "y").mapInArrow(run, "a bigint, b bigint")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets have a similarity of 4/5 or more; nodes: (node, row, n, wide).

    Whole sets are made of what sketches leave, which is little more than what is linked; they go when links are written.
    """
    pairs = written(plausible(nodes, pairs), "near-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "row"), "node").select(F.col("row").alias("__row"), F.col("node").alias("__node"))
    wanted = written(wanted, "near-wanted")
    texts = docs.select(row_key(docs).alias("row"), F.col("text").cast("string").alias("text")).join(small(wanted), F.col("row") == F.col("__row")).select("__node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("near")
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), lists([shingle_set(x.as_py()) for x in batch.column(1)])], ["node", "own"])

    sets = written(texts.mapInArrow(run, "node bigint, own array<bigint>").dropDuplicates(["node"]), "near-sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("sizes"))
    found = written(both.where((SHARE + OF) * F.col("common") >= SHARE * F.col("sizes")).select("a", "b"), "near-links")
    let_go(pairs, wanted, sets)
    return found


def print_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes that SimHash links: those of one fingerprint with the first of them, and the first ones of fingerprints
    within PRINT_BITS bits, by block masks and pivot tables; where sizes and sketches leave a link possible."""
    firsts = written(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "near-fingerprints")
    same = nodes.join(firsts, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    return linkable(same.union(simhash.links(firsts, PRINT_BITS, PIVOTS)), nodes)


def linkable(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b), the lesser node first and once, where sizes and sketches leave a link possible."""
    met = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = nodes.select("node", "n", *SKETCHES)
    return met.join(side.alias("x"), F.col("a") == F.col("x.node")).join(side.alias("y"), F.col("b") == F.col("y.node")).where(may_link("x", "y")).select("a", "b")


def star_pairs(members: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """Each member of a bucket with one of them, if they are not in one component yet."""
    hub = F.min(F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node", "component")).alias("hub")
    hubs = members.groupBy("key").agg(hub, F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key", "hub")
    met = members.join(hubs, "key").where(F.col("component") != F.col("hub.component")).select(F.col("node").alias("a"), F.col("hub.node").alias("b"))
    return linkable(met, nodes)


def cross_pairs(members: DataFrame, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """All pairs of a bucket's members that are not in one component, where sizes and sketches leave a link possible.

    A bucket is cut into blocks by the node, and each pair of blocks is a key of its own, so no bucket is one task's. At
    the first shingle that two sets have in common, what is left of each from its place on holds all others, so a pair
    counts where enough is left of both; where the first EARLY shared shingles of both have one in common before that
    place, the pair has come up there and doesn't again.
    """
    size = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    early = members.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("place"))).where(F.col("at") <= EARLY).groupBy("node").agg(F.collect_list(F.struct("place", "key")).alias("early"))
    cut = members.join(size.select("key", F.ceil(F.col("size") / block).alias("blocks")), "key").join(nodes.select("node", "n", *SKETCHES).join(early, "node"), "node")
    place = F.col("place")
    cut = cut.withColumn("early", F.transform(F.filter("early", lambda e: e["place"] < place), lambda e: e["key"]))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    cut = cut.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "component", "n", (F.col("n") - F.col("place")).alias("left"), "early", *SKETCHES)
    x, y = cut.alias("x"), cut.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high"))
    once = (F.col("x.node") < F.col("y.node")) & ((F.col("x.own") != F.col("y.own")) | (F.col("x.low") == F.col("x.high")))
    enough = (SHARE + OF) * F.least("x.left", "y.left") >= SHARE * (F.col("x.n") + F.col("y.n"))
    met = x.join(y, same & once & (F.col("x.component") != F.col("y.component")) & enough & may_link("x", "y") & ~F.arrays_overlap("x.early", "y.early"))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, row, component) of every row: the components of all pairs of texts whose sets of five-word shingles
    have a Jaccard similarity of 0.8 or more. Texts without words (null too) are copies of each other.

    SimHash comes first: fingerprints within PRINT_BITS bits, found by block masks and pivot tables, whose sets are then
    compared. It misses most pairs near 0.8, so there is an exact way for the rest: texts of such a pair share a
    shingle of their prefixes, and buckets of these have every pair. Members of a bucket are held against one of them,
    round by round as long as that links many, which makes a large group of near copies one component with as many
    rows as it has members; then all pairs that are still in two components are looked at. Sizes and sketches discard
    pairs that can't be linked, and the whole sets decide on the others.
    """
    with small_batches(docs.sparkSession):
        found = written(prints(docs), "near-prints")
        nodes = written(found.groupBy("node").agg(F.min("row").alias("row"), *(F.min(c).alias(c) for c in ("n", "fp", *SKETCHES, "wide"))), "near-nodes")
        keyed = found.select("node", F.posexplode("prefix").alias("place", "key"))
        shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key")
        members = written(keyed.join(shared, "key").distinct(), "near-members")
        grouped = components(verified(docs, nodes, print_pairs(nodes)))

        def now() -> DataFrame:
            return members.join(grouped, "node", "left").select("key", "node", "place", F.coalesce("component", "node").alias("component"))

        def joined(more: DataFrame) -> DataFrame:
            return components(grouped.toDF("a", "b").union(more))

        least = WORTH * members.select("node").distinct().count()
        for seed in range(MOST_ROUNDS):
            more = verified(docs, nodes, star_pairs(now(), nodes, seed))
            grouped = joined(more)
            if more.count() <= least:
                break
        grouped = joined(verified(docs, nodes, cross_pairs(now(), nodes, block)))
    let_go(members)
    return found.select("doc_id", "row", "node").join(grouped, "node", "left").select("doc_id", "row", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """`docs` with one row of each group of near-duplicates, that with the smallest doc_id, and the columns as they are.

    Rows are told apart by id and text: of several texts under one id each stays unless its own group has another
    row, and rows without an id are in groups like any other, behind those with one.
    """
    names = list(docs.columns)
    own, kept_row, repeats = free(names, "row"), free(names, "kept"), free(names, "repeats")
    rows = near_groups(docs, block).groupBy("component", "doc_id", "row").agg(F.count(F.lit(1)).alias("repeats"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "repeats")).alias("first")
    kept = written(rows.groupBy("component").agg(first).select(F.col("first.row").alias(kept_row), F.col("first.repeats").alias(repeats)), "near-kept")
    keyed = docs.withColumn(own, row_key(docs))
    once = keyed.join(kept.where(F.col(repeats) == 1), F.col(own) == F.col(kept_row), "left_semi")
    again = keyed.join(small(kept.where(F.col(repeats) > 1)), F.col(own) == F.col(kept_row), "left_semi")
    return once.unionByName(again.dropDuplicates([own])).drop(own)
