"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let_go, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge but the smallest of its component, which names it.

    `edges` has bigint columns a and b. Each round runs a large-star and a small-star step: joins with the
    minimum of a node's neighbours, found by a partial aggregate, so a node with very many neighbours is no task's
    group. Rounds end when the edges are those of stars already. Every round is a table in the shared folder, which
    goes when the next one is there. Loops are ignored; no edges give no rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-edges")
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if not seen["n"] or (seen["n"], seen["x"]) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = (seen["n"], seen["x"])
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
        before, now = now, written(small.select("e.a", "e.b").where("a <> b").distinct(), "component-edges")
        let_go(before)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
