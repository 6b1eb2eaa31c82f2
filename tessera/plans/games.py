"""Games on the test tables. Utilities are deterministic: game_id, n_items, mask, value for every coalition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import bits
from tessera.functions.text import answer_tokens, f1
from tessera.functions.utilities import unit_vector
from tessera.operators.coalitions import MOST_ITEMS, powerset
from tessera.operators.exact import subset_sums
from tessera.operators.prepare import with_duplicate
from tessera.operators.providers import degree_two
from tessera.operators.retrieval import nearest

SUPPLIERS, TYPES, SEGMENTS = 8, 5, 5
#: Kinds of events up to which each day meets all of them.
MOST_TYPES = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(utilities: DataFrame) -> DataFrame:
    return utilities.select("game_id", "n_items").distinct()


def coverage(served: DataFrame, sizes: DataFrame, value: Column, most_items: int) -> DataFrame:
    """From (game_id, m, n), how many elements the items of m cover between them, the coverage of each coalition.

    A coalition misses what only others cover: sums over subsets, so no coalition meets an element in a join.
    """
    total = served.groupBy("game_id").agg(F.sum("n").alias("total"))
    start = sizes.join(served, "game_id").select("game_id", "n_items", F.col("m").alias("mask"), F.col("n").cast("double").alias("inside"))
    inside = subset_sums(start, "inside", most_items=most_items).select("game_id", bits.full(F.col("n_items")).bitwiseXOR(F.col("mask")).alias("mask"), "inside")
    rows = powerset(sizes).join(total, "game_id").join(inside, ["game_id", "mask"], "left")
    return rows.withColumn("covered", F.col("total") - F.coalesce("inside", F.lit(0.0))).select("game_id", "n_items", "mask", value.alias("value"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_suppkey, item_idx): the eight suppliers of most revenue."""
    lines = table(spark, sf_dir, "lineitem")
    revenue = lines.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    best = revenue.orderBy(F.col("revenue").desc(), "l_suppkey").limit(SUPPLIERS)
    return best.select("l_suppkey", (F.row_number().over(Window.orderBy(F.col("revenue").desc(), "l_suppkey")) - 1).alias("item_idx"))


def supplier_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One game: a coalition of suppliers has ln(1 + orders that one of them serves)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    served = lines.join(F.broadcast(suppliers(spark, sf_dir)), "l_suppkey").groupBy("l_orderkey").agg(F.bit_or(bits.bit(F.col("item_idx"))).alias("m"))
    served = served.groupBy("m").agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).cast("bigint").alias("game_id"), "m", "n")
    sizes = spark.range(1).select(F.lit(0).cast("bigint").alias("game_id"), F.lit(SUPPLIERS).alias("n_items"))
    return coverage(served, sizes, F.ln(1 + F.col("covered")), SUPPLIERS)


def type_items(events: DataFrame) -> DataFrame:
    """(event_type, item_idx) of the first types by name."""
    names = events.select("event_type").where("event_type is not null").distinct().orderBy("event_type").limit(TYPES)
    return names.select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).alias("item_idx"))


def event_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A game for each day: event types have the number of distinct users they reach."""
    events = table(spark, sf_dir, "events")
    day = F.unix_date(F.to_date("ts")).cast("bigint")
    reached = events.join(F.broadcast(type_items(events)), "event_type").groupBy(day.alias("game_id"), "user_id").agg(F.bit_or(bits.bit(F.col("item_idx"))).alias("m"))
    served = reached.groupBy("game_id", "m").agg(F.count(F.lit(1)).alias("n"))
    sizes = served.select("game_id").distinct().withColumn("n_items", F.lit(TYPES))
    return coverage(served, sizes, F.col("covered"), TYPES)


def overlap_game(turns: DataFrame) -> DataFrame:
    """From (game_id, texts, target): a coalition of texts has the token F1 of its words with the target's. A game of more
    than MOST_ITEMS texts is an error, not cut: such games are for samplers.

    Only words of the target can be shared, so a coalition meets those alone, with their counts by text in an array.
    """
    words = F.transform("texts", answer_tokens)
    rows = turns.select("game_id", F.size("texts").alias("n_items"), words.alias("words"), answer_tokens(F.col("target")).alias("gold"))
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    rows = rows.select("game_id", "n_items", F.transform("words", F.size).alias("sizes"), F.size("gold").alias("gold_size"), F.transform(F.array_distinct("gold"), lambda w: F.struct(count(F.col("gold"), w).alias("g"), F.transform("words", lambda t: count(t, w)).alias("by"))).alias("shared"))
    fits = F.when(F.col("n_items") <= MOST_ITEMS, bits.full(F.col("n_items"))).otherwise(F.raise_error(F.lit(f"all coalitions of more than {MOST_ITEMS} items")).cast("bigint"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), fits)).alias("mask"))
    mask = F.col("mask")
    add = lambda xs: F.aggregate(F.filter(xs, lambda _, i: bits.has(mask, i)), F.lit(0), lambda s, x: s + x)
    both = F.aggregate("shared", F.lit(0), lambda s, w: s + F.least(w["g"], add(w["by"])))
    return rows.select("game_id", "n_items", "mask", f1(both, add(F.col("sizes")), F.col("gold_size")).alias("value"))


def unigram_log_probs(turns: DataFrame) -> DataFrame:
    """From (game_id, texts, target): (game_id, n_items, mask, lp, lp_empty, tokens), the natural log-probability of the
    target's words under those of a coalition's texts. Counts have one added for each different word of the target and for
    all others together; an empty target has 0. A game of more than MOST_ITEMS texts is an error."""
    rows = turns.select("game_id", F.size("texts").alias("n_items"), F.transform("texts", answer_tokens).alias("words"), answer_tokens(F.col("target")).alias("gold"))
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    own = F.transform(F.array_distinct("gold"), lambda w: F.struct(count(F.col("gold"), w).alias("g"), F.transform("words", lambda t: count(t, w)).alias("by")))
    rows = rows.select("game_id", "n_items", F.transform("words", F.size).alias("sizes"), F.size("gold").alias("tokens"), own.alias("own"))
    rows = rows.join(powerset(rows.select("game_id", "n_items")).select("game_id", "mask"), "game_id")
    add = lambda xs: F.aggregate(F.filter(xs, lambda _, i: bits.has(F.col("mask"), i)), F.lit(0), lambda s, x: s + x)
    log_prob = lambda held, size: F.aggregate("own", F.lit(0.0), lambda s, w: s + w["g"] * F.ln((held(w["by"]) + 1) / (size + F.size("own") + 1)))
    return rows.select("game_id", "n_items", "mask", log_prob(add, add(F.col("sizes"))).alias("lp"), log_prob(lambda _: F.lit(0), F.lit(0)).alias("lp_empty"), "tokens")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_id, texts, target): the last turn and all before it; conversations of one turn are no game."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    texts = F.transform("t", lambda x: x["text"])
    return rows.where(F.size("t") > 1).select(F.col("conv_id").alias("game_id"), F.slice(texts, F.lit(1), F.size("t") - 1).alias("texts"), F.element_at(texts, -1).alias("target"))


def turn_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_game(conversations(spark, sf_dir))


def turn_log_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_log_probs(conversations(spark, sf_dir))


def duplicate_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of two turns or more before the last, with the first turn once more at the end."""
    rows = conversations(spark, sf_dir).where(F.size("texts") > 1)
    return overlap_game(rows.withColumn("texts", with_duplicate(F.col("texts"), 0, 62)))


def segment_effects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Effects (game_id, item_idx, w) and pairs (game_id, i, j, value) of a game of order two for each nation: market
    segments have their highest balance in thousands, and two of them the product of their shares, its sign by turns."""
    customers = table(spark, sf_dir, "customer")
    names = customers.select("c_mktsegment").where("c_mktsegment is not null").distinct().orderBy("c_mktsegment").limit(SEGMENTS)
    names = names.select("c_mktsegment", (F.row_number().over(Window.orderBy("c_mktsegment")) - 1).alias("item_idx"))
    own = customers.groupBy(F.col("c_nationkey").cast("bigint").alias("game_id"), "c_mktsegment").agg(F.max("c_acctbal").alias("balance"), F.count(F.lit(1)).alias("n"))
    nations = own.select("game_id").distinct()
    grid = nations.crossJoin(F.broadcast(names)).join(own, ["game_id", "c_mktsegment"], "left").select("game_id", "item_idx", (F.coalesce("balance", F.lit(0.0)) / 1000).alias("w"), F.coalesce("n", F.lit(0)).alias("n"))
    share = grid.groupBy("game_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("item_idx", "n"))).alias("by"))
    pair = share.select("game_id", "total", "by", F.explode(bits.pairs(F.lit(SEGMENTS))).alias("p"))
    sign = F.when((F.col("p.i") + F.col("p.j")) % 2 == 0, 1.0).otherwise(-1.0)
    value = sign * F.coalesce(F.col("by")[F.col("p.i")], F.lit(0)) * F.coalesce(F.col("by")[F.col("p.j")], F.lit(0)) / (F.col("total") * F.col("total"))
    return grid.select("game_id", "item_idx", "w"), pair.select("game_id", "p.i", "p.j", value.alias("value"))


def segment_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects, pairs = segment_effects(spark, sf_dir)
    sizes = effects.select("game_id").distinct().withColumn("n_items", F.lit(SEGMENTS))
    return degree_two(effects, pairs)(powerset(sizes))


#: The vectors that are queries of the retrieval game: those whose id is divisible by this.
QUERY_STEP = 50


def retrieved(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """(query_id, vec_id, item_idx, pred, truth): the k nearest of each query; gold ones have the query's label."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("embedding", unit_vector(F.col("embedding")))
    asked = vectors.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("wanted"))
    found = nearest(vectors, asked, k)
    return found.select("query_id", "vec_id", (F.col("place") - 1).alias("item_idx"), (-F.col("distance")).alias("pred"), (F.col("label") == F.col("wanted")).cast("int").alias("truth"))
