"""Conversations as a tree of shared beginnings: each owns a chain of nodes, and chains are added up from below."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bucketed, remainder, small, take_turn, with_values, words, written

#: A conversation's first turns come from the one that starts its block of so many ids; fewer than HEAD of them do.
BLOCK, HEAD = 20, 4
#: Depths of a conversation whose sums are taken in one window.
STRETCH = 4096
#: Ids in one piece of a list of ids that is hashed.
PIECE = 65_536
LANES = ["a", "b", "c", "d"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, said, words): turns in order from 1; said: a digest of role and text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(" "), role, text).cast("binary"), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), said.alias("said"),
        F.size(words(text, fold=False)).cast("bigint").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.asc_nulls_first("turn"), F.asc("said"), F.asc("row")]
    # ranges of (conversation, place), so that a long conversation lies in several
    dealt = written(written(rows, "turns").repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()), "turn-ranges")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order)).cast("bigint"))
    size = dealt.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = size.join(size.groupBy("conv_id").agg(F.count(F.lit(1)).alias("ranges")).where("ranges > 1").select("conv_id"), "conv_id").select("conv_id", "range", before.alias("before"))
    placed = ranked.join(small(written(before, "ranges-before")), ["conv_id", "range"], "left")
    return written(placed.select("conv_id", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"), "said", "words"), "ranked-turns")


def rebuilt(ranked: DataFrame, block: int = BLOCK, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, said, words) of the rebuilt conversations, depths from 1, and (conv_id, last) with their lengths.

    The first h turns are those of conversation c - c % block, h being crc32(c) % head; the remainder has c's sign.
    """
    sizes = written(ranked.groupBy("conv_id").agg(F.max("rank").alias("n")), "conversation-sizes")
    info = sizes.select("conv_id", "n", remainder(F.col("conv_id"), head).alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    info = info.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    info = info.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n")
    info = written(info.withColumn("last", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversation-info")
    own = with_values(ranked, info.select("conv_id", "h", "taken"), ["conv_id"]).where(F.col("rank") > F.col("h"))
    own = own.select("conv_id", (F.col("rank") - F.col("h") + F.col("taken")).alias("depth"), "said", "words")
    heads = ranked.where(F.col("rank") < head).select(F.col("conv_id").alias("base"), F.col("rank").alias("depth"), "said", "words")
    first = info.where("taken > 0").join(heads, "base").where(F.col("depth") <= F.col("taken")).select("conv_id", "depth", "said", "words")
    return own.unionByName(first), info.select("conv_id", "last")


def running(rows: DataFrame, sums: list[str], backward: bool = False) -> DataFrame:
    """`rows` (conv_id, depth, ...) with each of `sums` added up over the conversation from its start, or from its end.

    Windows are stretches of depths; the totals of earlier stretches are added, so no window is a whole long conversation.
    """
    rows = rows.withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    totals = rows.groupBy("conv_id", "stretch").agg(*(F.sum(c).alias(c) for c in sums))
    order = F.desc if backward else F.asc
    earlier = Window.partitionBy("conv_id").orderBy(order("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    # one row a stretch: what earlier stretches come to
    long = totals.groupBy("conv_id").agg(F.count(F.lit(1)).alias("stretches")).where("stretches > 1").select("conv_id")
    before = totals.join(long, "conv_id").select("conv_id", "stretch", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in sums))
    within = Window.partitionBy("conv_id", "stretch").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("*", *(F.sum(c).over(within).alias(f"within_{c}") for c in sums)).drop(*sums)
    out = inside.join(small(written(before, "stretches-before")), ["conv_id", "stretch"], "left")
    return out.select(*(c for c in rows.columns if c not in (*sums, "stretch")), *((F.col(f"within_{c}") + F.coalesce(f"before_{c}", F.lit(0))).alias(c) for c in sums))


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, node, words): node is a digest of the first turns up to this one.

    A turn and its place give four numbers of 32 bits, whose sums over the turns are the prefix: sums can be taken piece
    by piece, so a conversation of any length is dealt to many tasks. Two prefixes of 10**12 meet by chance with a
    probability of about 10**-15.
    """
    hexed = F.md5(F.concat_ws(" ", "depth", "said").cast("binary"))
    lanes = [F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 10).cast("bigint").alias(c) for k, c in enumerate(LANES)]
    summed = running(rows.select("conv_id", "depth", "words", *lanes), LANES)
    return bucketed(summed.select("conv_id", "depth", F.unhex(F.md5(F.concat_ws(" ", "depth", *LANES).cast("binary"))).alias("node"), "words"), "prefixes", "conv_id", "depth")


def at_depth(asked: DataFrame, nodes: DataFrame, minima: DataFrame) -> DataFrame:
    """`asked` (conv_id, depth, ...) with the `owner` of the prefix of that depth: a batch of look-ups, one a conversation.

    Prefixes that only one conversation has are not in `minima`; their owner is that conversation.
    """
    found = with_values(asked.join(nodes.select("conv_id", "depth", "node"), ["conv_id", "depth"]), minima.select("node", "owner"), ["node"])
    return found.withColumn("owner", F.coalesce("owner", "conv_id")).drop("node")


def first_owned(lengths: DataFrame, nodes: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv_id, last, first): the depth from which a conversation is the smallest member of its prefixes, last + 1 if it
    never is. Owning a prefix is owning all longer ones, so depths are halved, all conversations at once."""
    found = written(lengths.select("conv_id", "last", F.lit(1).cast("bigint").alias("low"), (F.col("last") + 1).alias("high")), "owned")
    while not (open_ := found.where("low < high")).isEmpty():
        asked = at_depth(open_.withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2)), nodes, minima)
        owns = F.col("owner") == F.col("conv_id")
        step = asked.select("conv_id", "last", F.when(owns, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(owns, F.col("depth")).otherwise(F.col("high")).alias("high"))
        found = written(step.unionByName(found.where("low >= high")), "owned")
    return found.select("conv_id", "last", F.col("low").alias("first"))


def up_the_chains(chains: DataFrame, sums: list[str]) -> DataFrame:
    """(conv_id, sums): each chain's own sums and those of all chains that hang on it, however far below.

    `chains`: (conv_id, parent, sums). Ways up are doubled in each round: after k rounds a chain has all that hangs less
    than 2**k chains below it, so the rounds grow with the logarithm of the tree's height.
    """
    total, up = chains.select("conv_id", *sums), written(chains.where("parent is not null").select("conv_id", "parent"), "ways-up")
    while not up.isEmpty():
        below = up.join(total, "conv_id").groupBy(F.col("parent").alias("conv_id")).agg(*(F.sum(c).alias(f"more_{c}") for c in sums))
        total = written(total.join(below, "conv_id", "left").select("conv_id", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums)), "chain-sums")
        two = with_values(up, up.select(F.col("conv_id").alias("parent"), F.col("parent").alias("above")), ["parent"])
        up = written(two.where("above is not null").select("conv_id", F.col("above").alias("parent")), "ways-up")
    return total


def id_lists(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256): SHA-256 of the ids of the conversations that end at a node, in order and comma-joined.

    Ids are sorted by ranges of (node, id) and joined into pieces where they lie; a hash takes the pieces of its node one
    after the other, so a node where a third of all conversations end is neither collected nor held as one text.
    """
    schema = "owner bigint, depth bigint, first bigint, ids string"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("tries")
        node, ids = None, []
        for batch in batches:
            out = []
            for owner, depth, conv in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if node != (owner, depth) or len(ids) == PIECE:
                    out += [(*node, ids[0], ",".join(map(str, ids)))] if ids else []
                    node, ids = (owner, depth), []
                ids.append(conv)
            yield rows(out)
        yield rows([(*node, ids[0], ",".join(map(str, ids)))] if ids else [])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["owner", "depth", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("tries")
        node, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for owner, depth, _, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if node == (owner, depth):
                    state.update(b",")
                else:
                    out += [(*node, state.hexdigest())] if node else []
                    node, state = (owner, depth), hashlib.sha256()
                state.update(ids.encode())
            yield done(out)
        yield done([(*node, state.hexdigest())] if node else [])

    def done(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["owner", "depth", "ends_sha256"])

    key = ["owner", "depth", "conv_id"]
    pieces = ends.select(*key).repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(joined, schema)
    return written(pieces, "id-pieces").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(hashed, "owner bigint, depth bigint, ends_sha256 string")


def prefix_tree(conversations: DataFrame, block: int = BLOCK, head: int = HEAD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the tree
    of all beginnings of rebuilt conversations.

    Turns are in order of `turn`, null first, and those of one number in order of their digests, repeated rows included.
    A null role or text is empty. Rows without a conv_id belong to no conversation. A conversation whose own turns are
    all replaced by those of an absent one is turnless and ends at the root. No conversations give no rows, not even a
    root. Other columns are not looked at.
    """
    rows, lengths = rebuilt(turns(conversations), block, head)
    nodes = prefixes(rows)
    minima = nodes.groupBy("node").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n"))
    minima = written(minima.where("n > 1"), "prefix-minima")
    top = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).first()
    is_top = F.col("conv_id") == F.lit(top["conv_id"]).cast("bigint")
    owned = first_owned(lengths, nodes, minima)

    # a chain hangs on the node before its first; where that is, a conversation that owns nothing ends
    before = at_depth(owned.where("first > 1").select("conv_id", (F.col("first") - 1).alias("depth")), nodes, minima).select("conv_id", "owner")
    owned = owned.join(before, "conv_id", "left").withColumn("owner", F.when(is_top, F.lit(None)).otherwise(F.coalesce("owner", F.lit(top["conv_id"]).cast("bigint"))))
    owned = written(owned.withColumn("first", F.when(is_top, F.lit(0)).otherwise(F.col("first")).cast("bigint")), "chains")
    chains = owned.where("first <= last")
    ends = id_lists(owned.select(F.when(F.col("first") <= F.col("last"), F.col("conv_id")).otherwise(F.col("owner")).alias("owner"), F.col("last").alias("depth"), "conv_id"))

    root = owned.where(is_top).select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("words"), F.lit(top["n"]).cast("bigint").alias("n"), "first", "last", "owner")
    own = with_values(nodes, chains.select("conv_id", "first", "last", "owner"), ["conv_id"]).where(F.col("depth") >= F.col("first"))
    own = own.join(minima.select("node", "n"), "node", "left").select("conv_id", "depth", "words", F.coalesce("n", F.lit(1)).alias("n"), "first", "last", "owner").unionByName(root)
    hung = chains.where(F.col("owner").isNotNull()).select(F.col("owner").alias("on_chain"), (F.col("first") - 1).alias("on_depth"), "conv_id")
    branches = hung.groupBy(F.col("on_chain").alias("conv_id"), F.col("on_depth").alias("depth")).agg(F.count(F.lit(1)).alias("branches"))
    own = own.join(branches, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("branches", F.lit(0)) + (F.col("depth") < F.col("last")).cast("bigint"))
    own = own.withColumn("leaves", (F.col("n_children") == 0).cast("bigint")).withColumn("saved", (F.col("n") - 1) * F.col("words"))
    own = written(own.select("conv_id", "depth", F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("owner")).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "leaves", "saved"), "tree-nodes")

    alone = own.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    total = up_the_chains(chains.select("conv_id", F.col("owner").alias("parent")).join(alone, "conv_id"), ["leaves", "saved"])
    hanging = hung.join(total, "conv_id").groupBy(F.col("on_chain").alias("conv_id"), F.col("on_depth").alias("depth")).agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    full = own.join(hanging, ["conv_id", "depth"], "left").withColumn("leaves", F.col("leaves") + F.coalesce("hung_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("hung_saved", F.lit(0)))
    full = running(full.drop("hung_leaves", "hung_saved"), ["leaves", "saved"], backward=True)
    full = full.join(ends.withColumnRenamed("owner", "conv_id"), ["conv_id", "depth"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
