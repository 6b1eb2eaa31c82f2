"""Truncated walks along random orders, a step a round: utilities are asked for when a walk gets to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import bits
from tessera.operators.coalitions import orders
from tessera.operators.exact import finite
from tessera.operators.providers import Provider
from tessera.sources.scratch import kept, scratch_dir

MEMO = "game_id bigint, n_items int, mask bigint, value double, size int"


def ask(wanted: DataFrame, score: Provider, path: str) -> None:
    """Adds the values of `wanted` (game_id, n_items, mask), which is read from a table, to the one at `path`: null where the
    scorer has none or one that isn't finite."""
    answers = score(wanted).groupBy("game_id", "mask").agg(F.max(finite(F.col("value").cast("double"))).alias("value"))
    rows = wanted.join(answers, ["game_id", "mask"], "left")
    rows.select("game_id", "n_items", "mask", "value", bits.size(F.col("mask")).cast("int").alias("size")).write.partitionBy("size").mode("append").parquet(path)


def step_walks(games: DataFrame, score: Provider, count: int, tolerance: float = 0.01, budget: int | None = None, seed: int = 42) -> DataFrame:
    """(game_id, item_idx, phi, evaluations): what truncated_shapley() gives, from a scorer instead of a table.

    All orders of all games go on by one item a round; what they ask for together is scored once. With `budget` an order
    waits before a coalition without a score unless it and all orders before it can end within what is left, whatever they
    ask for, or it is the first that hasn't ended: so nothing is scored that the orders in turn wouldn't have been. Where
    the first one finds nothing left the game is over, and what later orders did meanwhile doesn't count. Windows go over the
    orders of one game, `count` at most; no game is in one task. The empty and the full coalition are scored at the
    start and count as two evaluations. A missing or infinite utility ends its order; games without any have zeros, and
    no games no rows. Games of up to 62 items, one row each; other columns aren't read.
    """
    spark, memo, rounds = games.sparkSession, scratch_dir(games.sparkSession, "scores"), scratch_dir(games.sparkSession, "rounds")
    games = kept(games.select(F.col("game_id").cast("bigint").alias("game_id"), F.col("n_items").cast("int").alias("n_items")).where("n_items > 0"), "games")
    top_mask = bits.full(F.col("n_items"))
    ask(games.select("game_id", "n_items", F.explode(F.array_distinct(F.array(F.lit(0).cast("bigint"), top_mask))).alias("mask")), score, memo)
    scores = lambda: spark.read.schema(MEMO).parquet(memo)
    spent = lambda: scores().groupBy("game_id").agg((2 + F.count_if((F.col("size") > 0) & (F.col("size") < F.col("n_items")))).alias("evaluations"))

    ends = scores().groupBy("game_id").agg(F.max(F.when(F.col("mask") == 0, F.col("value"))).alias("last"), F.max(F.when(F.col("mask") == top_mask, F.col("value"))).alias("top"))
    walks = orders(games, count, seed).join(ends, "game_id").where("last is not null")
    walks = walks.select("game_id", "n_items", F.col("iteration").cast("int"), "order", F.lit(0).alias("step"), F.lit(0).cast("bigint").alias("mask"), "last", "top")
    low, high, turn = 0, 0, 0
    while low is not None:
        path = f"{rounds}/turn={turn}"
        near = F.abs(F.col("top") - F.col("last")) < tolerance
        rows = walks.withColumn("cut", (F.col("iteration") > 1) & F.coalesce(near, F.lit(False)))
        rows = rows.withColumn("to", F.col("mask").bitwiseOR(bits.bit(F.element_at("order", F.col("step") + 1))))
        have = scores().where(F.col("size").between(low + 1, high + 1)).select("game_id", F.col("mask").alias("to"), F.lit(True).alias("known"))
        rows = rows.join(have, ["game_id", "to"], "left")
        act(rows, None if budget is None else spent(), budget).write.parquet(path)
        now = spark.read.parquet(path)
        ask(now.where("act = 'ask'").select("game_id", "n_items", F.col("to").alias("mask")).distinct(), score, memo)
        values = scores().where(F.col("size").between(low + 1, high + 1)).select("game_id", F.col("mask").alias("to"), "value")
        went = now.where("act in ('go', 'ask') and step + 1 < n_items").join(values, ["game_id", "to"]).where("value is not null")
        went = went.select("game_id", "n_items", "iteration", "order", F.col("step") + 1, F.col("to"), "value", "top")
        walks = went.union(now.where("act = 'wait'").select(*walks.columns)).toDF(*walks.columns)
        if budget is not None:
            walks = walks.join(now.where("act = 'stop'").select("game_id").distinct(), "game_id", "left_anti").select(*walks.columns)
        at = F.when(F.col("act") == "wait", F.col("step")).when(F.col("act").isin("go", "ask") & (F.col("step") + 1 < F.col("n_items")), F.col("step") + 1)
        low, high = now.agg(F.min(at), F.max(at)).first()
        turn += 1

    every = spark.read.parquet(rounds)
    stops = every.where("act = 'stop'").select("game_id", F.struct("iteration", "step").alias("stop"))
    made = every.where("act in ('go', 'ask', 'cut')").join(stops, "game_id", "left").where(F.col("stop").isNull() | (F.struct("iteration", "step") < F.col("stop")))
    steps = made.where("act <> 'cut'").join(scores().select("game_id", F.col("mask").alias("to"), "value"), ["game_id", "to"]).where("value is not null")
    steps = steps.select("game_id", F.element_at("order", F.col("step") + 1).alias("item_idx"), (F.col("value") - F.col("last")).alias("delta"))
    cuts = made.where("act = 'cut'").select("game_id", F.explode(F.slice("order", F.col("step") + 1, F.size("order"))).alias("item_idx"), F.lit(0.0).alias("delta"))
    phi = steps.unionByName(cuts).groupBy("game_id", "item_idx").agg(F.avg("delta").alias("phi"))
    items = games.join(spent(), "game_id").select("game_id", "evaluations", F.explode(bits.items(F.col("n_items"))).alias("item_idx"))
    return items.join(phi, ["game_id", "item_idx"], "left").select("game_id", F.col("item_idx").cast("int").alias("item_idx"), F.coalesce("phi", F.lit(0.0)).alias("phi"), "evaluations")


def act(rows: DataFrame, spent: DataFrame | None, budget: int | None) -> DataFrame:
    """`rows` with what each order does: cut, go (to a known coalition), ask, wait or stop (and end its game)."""
    going = F.when(F.col("cut"), "cut").when(F.col("known"), "go")
    if spent is None:
        return rows.withColumn("act", going.otherwise("ask"))
    game = Window.partitionBy("game_id")
    most = F.when(F.col("cut"), 0).otherwise(F.col("n_items") - 1 - F.col("step"))
    rows = rows.join(spent, "game_id").withColumn("left", F.lit(budget) - F.col("evaluations"))
    rows = rows.withColumn("reserve", F.sum(most).over(game.orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("first", F.min(F.when(~F.col("cut"), F.col("iteration"))).over(game) == F.col("iteration"))
    asks = (F.col("reserve") <= F.col("left")) | (F.col("first") & (F.col("left") > 0))
    return rows.withColumn("act", going.when(asks, "ask").when(F.col("first"), "stop").otherwise("wait")).drop("left", "reserve", "first", "evaluations")
