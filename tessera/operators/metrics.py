"""Agreement of attributions, interactions and predictions with a reference.

`scores` frames have key columns, an item column, and columns pred and truth. Ties in a top-k go to the smaller item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import bits
from tessera.operators.coalitions import hamming1_pairs
from tessera.operators.exact import finite


def average_rank(by: Window, order: Column) -> Column:
    """Rank from 1 with ties at their mean; `by` is a partition without an order."""
    ties = Window.partitionBy(*by)
    return F.rank().over(ties.orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, order)) - 1) / 2.0


def correlation(x: str, y: str) -> Column:
    """An aggregate; null where a side doesn't vary."""
    norm = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(norm > 0, F.covar_pop(x, y) / F.when(norm > 0, norm))


def pearson(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Null where a side doesn't vary."""
    return scores.groupBy(*keys).agg(correlation("pred", "truth").alias("value"))


def spearman(scores: DataFrame, keys: list[str]) -> DataFrame:
    by = [F.col(k) for k in keys]
    ranked = scores.select(*keys, average_rank(by, F.col("pred")).alias("pred"), average_rank(by, F.col("truth")).alias("truth"))
    return pearson(ranked, keys)


def kendall(scores: DataFrame, keys: list[str], item: str = "item_idx") -> DataFrame:
    """Tau-b, from the pairs of the items of one key; those are players of a game or pairs of them, a bounded number."""
    rows = scores.groupBy(*keys).agg(F.collect_list(F.struct(F.col(item).alias("k"), F.col("pred").alias("p"), F.col("truth").alias("t"))).alias("xs"))
    sign = lambda a, b: F.signum(a - b)
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("s", "p", "t")))

    def add(acc, a, b):
        p, t = sign(a["p"], b["p"]), sign(a["t"], b["t"])
        return F.struct((acc["s"] + p * t).alias("s"), (acc["p"] + F.abs(p)).alias("p"), (acc["t"] + F.abs(t)).alias("t"))

    total = F.aggregate("xs", zero, lambda acc, a: F.aggregate("xs", acc, lambda inner, b: F.when(a["k"] < b["k"], add(inner, a, b)).otherwise(inner)))
    rows = rows.select(*keys, total.alias("c"))
    norm = F.sqrt(F.col("c.p") * F.col("c.t"))
    return rows.select(*keys, F.when(norm > 0, F.col("c.s") / norm).alias("value"))


def r2(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the variance explained; null if the truth doesn't vary or there are fewer than two rows."""
    mean = F.avg("truth").over(Window.partitionBy(*keys))
    rows = scores.select(*keys, ((F.col("truth") - F.col("pred")) * (F.col("truth") - F.col("pred"))).alias("e"), ((F.col("truth") - mean) * (F.col("truth") - mean)).alias("d"))
    return rows.groupBy(*keys).agg(F.when(F.sum("d") > 0, 1 - F.sum("e") / F.sum("d")).alias("value"))


def delta_scores(utilities: DataFrame) -> DataFrame:
    """From (game_id, n_items, mask, pred, truth) the same for differences of neighbouring coalitions, each pair once."""
    own = utilities.dropDuplicates(["game_id", "mask"])
    side = lambda s: own.select("game_id", F.col("mask").alias(f"mask_{s}"), F.col("pred").alias(f"pred_{s}"), F.col("truth").alias(f"truth_{s}"))
    both = hamming1_pairs(own).join(side("with"), ["game_id", "mask_with"]).join(side("without"), ["game_id", "mask_without"])
    return both.select("game_id", "item_idx", "mask_without", (F.col("pred_with") - F.col("pred_without")).alias("pred"), (F.col("truth_with") - F.col("truth_without")).alias("truth"))


def top(scores: DataFrame, keys: list[str], k: int, by: Column, item: str = "item_idx") -> DataFrame:
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(by.desc(), F.col(item)))).where(F.col("place") <= k)


def ndcg(scores: DataFrame, keys: list[str], k: int = 5, shift: bool = True) -> DataFrame:
    """Linear gains with log2 discounts; predictions that tie share the mean gain of their places.

    `shift` takes the least truth of a key from all, so that gains aren't negative. Null if the ideal is 0.
    """
    game = Window.partitionBy(*keys)
    gain = F.col("truth") - F.min("truth").over(game) if shift else F.col("truth")
    rows = scores.select(*keys, "pred", gain.alias("gain"))
    discount = lambda r: F.when(r <= k, 1.0 / F.log2(r + 1.0)).otherwise(0.0)
    rows = rows.select(*keys, "pred", "gain", F.row_number().over(game.orderBy(F.col("pred").desc())).alias("r"), F.row_number().over(game.orderBy(F.col("gain").desc())).alias("best"))
    tied = rows.groupBy(*keys, "pred").agg((F.avg("gain") * F.sum(discount(F.col("r")))).alias("dcg"), F.sum(F.col("gain") * discount(F.col("best"))).alias("ideal"))
    return tied.groupBy(*keys).agg(F.when(F.sum("ideal") > 0, F.sum("dcg") / F.sum("ideal")).alias("value"))


def average_precision(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Area under precision and recall over the distinct scores, descending; truth is 0 or 1. Null without or with nothing but gold."""
    by_score = scores.groupBy(*keys, "pred").agg(F.sum("truth").alias("hits"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(*keys).orderBy(F.col("pred").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = by_score.select(*keys, "hits", "n", (F.sum("hits").over(down) / F.sum("n").over(down)).alias("precision"))
    gold, size = F.sum("hits"), F.sum("n")
    return rows.groupBy(*keys).agg(F.when((gold > 0) & (gold < size), F.sum(F.col("hits") * F.col("precision")) / gold).alias("value"))


def recall_at(scores: DataFrame, keys: list[str], k: int, item: str = "item_idx") -> DataFrame:
    """Share of the gold items (truth 1) among the k with the highest pred; null without gold."""
    gold = scores.groupBy(*keys).agg(F.sum("truth").alias("gold"))
    hits = top(scores, keys, k, F.col("pred"), item).groupBy(*keys).agg(F.sum("truth").alias("hits"))
    return gold.join(hits, keys).select(*keys, F.when(F.col("gold") > 0, F.col("hits") / F.col("gold")).alias("value"))


def precision_at_gold(scores: DataFrame, keys: list[str], item: str = "item_idx") -> DataFrame:
    """Recall at as many items as are gold."""
    game = Window.partitionBy(*keys)
    rows = scores.select(*keys, "truth", F.sum("truth").over(game).alias("gold"), F.row_number().over(game.orderBy(F.col("pred").desc(), F.col(item))).alias("place"))
    return rows.groupBy(*keys).agg(F.when(F.max("gold") > 0, F.sum(F.when(F.col("place") <= F.col("gold"), F.col("truth")).otherwise(0)) / F.max("gold")).alias("value"))


def top_k_mask(attributions: DataFrame, k: int) -> DataFrame:
    """(game_id, top): mask of the k items with the highest phi."""
    rows = top(attributions, ["game_id"], k, F.col("phi"))
    return rows.groupBy("game_id").agg(F.bit_or(bits.bit(F.col("item_idx"))).alias("top"))


def top_k_drop(attributions: DataFrame, utilities: DataFrame, k: int) -> DataFrame:
    """(game_id, value): v(N) - v(N without the top k). Games without both utilities have null; k over n has no row."""
    best = top_k_mask(attributions, k)
    sizes = utilities.select("game_id", "n_items").distinct().where(F.col("n_items") >= k)
    wanted = best.join(sizes, "game_id").select("game_id", F.explode(F.array(F.struct(bits.full(F.col("n_items")).alias("mask"), F.lit(1.0).alias("sign")), F.struct(bits.without(bits.full(F.col("n_items")), F.col("top")).alias("mask"), F.lit(-1.0).alias("sign")))).alias("x"))
    rows = wanted.select("game_id", "x.mask", "x.sign").join(utilities.select("game_id", "mask", finite(F.col("value")).alias("v")), ["game_id", "mask"], "left")
    return rows.groupBy("game_id").agg(F.when(F.count("v") == 2, F.sum(F.col("v") * F.col("sign"))).alias("value"))


def top_k_only(attributions: DataFrame, utilities: DataFrame, k: int) -> DataFrame:
    """(game_id, value): utility of the top k alone."""
    return top_k_mask(attributions, k).withColumnRenamed("top", "mask").join(utilities, ["game_id", "mask"]).select("game_id", "value")


def pair_recovery(pairs: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(game_id, value): mean over the k greatest pairs of the share of their two items that is gold, over k."""
    best = pairs.withColumn("place", F.row_number().over(Window.partitionBy("game_id").orderBy(F.col("value").desc(), "i", "j"))).where(F.col("place") <= k)
    ends = best.select("game_id", F.explode(F.array("i", "j")).alias("item_idx"))
    marked = gold.select("game_id", "item_idx", F.lit(1).alias("is_gold")).distinct()
    return ends.join(marked, ["game_id", "item_idx"], "left").groupBy("game_id").agg((F.sum(F.coalesce("is_gold", F.lit(0))) / (2.0 * k)).alias("value"))


def pair_recall(pairs: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(game_id, value): share of the pairs of gold items among the k greatest pairs; games with one gold item or none have no row."""
    best = pairs.withColumn("place", F.row_number().over(Window.partitionBy("game_id").orderBy(F.col("value").desc(), "i", "j")))
    mark = gold.groupBy("game_id").agg(F.bit_or(bits.bit(F.col("item_idx"))).alias("g"))
    rows = best.join(mark, "game_id").withColumn("is_gold", (bits.has(F.col("g"), F.col("i")) & bits.has(F.col("g"), F.col("j"))).cast("int"))
    return rows.groupBy("game_id").agg(F.sum("is_gold").alias("all"), F.sum(F.when(F.col("place") <= k, F.col("is_gold")).otherwise(0)).alias("hits")).where("all > 0").select("game_id", (F.col("hits") / F.col("all")).alias("value"))


def extreme_pair(pairs: DataFrame, i: int, j: int, largest: bool = True) -> DataFrame:
    """Share of the games whose greatest (or least) interaction is that of i and j: columns n, value."""
    order = F.struct(F.col("value") * (1 if largest else -1), -F.col("i"), -F.col("j"))
    best = pairs.groupBy("game_id").agg(F.max_by(F.struct("i", "j"), order).alias("p"))
    return best.agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("p.i") == i) & (F.col("p.j") == j)).cast("double")).alias("value"))


def top_overlap(scores: DataFrame, keys: list[str], k: int, item: str = "item_idx") -> DataFrame:
    """Share that the k items largest by size in pred and in truth have in common."""
    game = Window.partitionBy(*keys)
    place = lambda c: F.row_number().over(game.orderBy(F.abs(c).desc(), F.col(item))) <= k
    rows = scores.select(*keys, (place(F.col("pred")) & place(F.col("truth"))).cast("int").alias("both"))
    return rows.groupBy(*keys).agg((F.sum("both") / float(k)).alias("value"))


def sign_agreement(scores: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """n_strong, sign_agree, weak_frac: rows strong on both sides are at least `share` of the largest there."""
    game = Window.partitionBy(*keys)
    strong = lambda c: (F.max(F.abs(c)).over(game) > 0) & (F.abs(c) >= share * F.max(F.abs(c)).over(game))
    rows = scores.select(*keys, (strong(F.col("pred")) & strong(F.col("truth"))).alias("strong"), (F.signum(F.col("pred")) == F.signum(F.col("truth"))).alias("same"))
    n = F.count_if("strong")
    return rows.groupBy(*keys).agg(n.alias("n_strong"), F.avg(F.when(F.col("strong"), F.col("same").cast("double"))).alias("sign_agree"), (1 - n / F.count(F.lit(1))).alias("weak_frac"))


def correctness_split(pairs: DataFrame, verdicts: DataFrame, share: float = 0.1) -> DataFrame:
    """By `correct` (game_id, correct): the share of strong interactions that are positive, and how many are strong."""
    strong = F.abs("value") >= share * F.max(F.abs("value")).over(Window.partitionBy("game_id"))
    rows = pairs.withColumn("strong", strong & (F.col("value") != 0)).where("strong").join(verdicts, "game_id")
    return rows.groupBy("correct").agg(F.count(F.lit(1)).alias("n_strong"), F.avg((F.col("value") > 0).cast("double")).alias("positive"))


def mean_scaled(pairs: DataFrame) -> DataFrame:
    """(i, j, value): mean over games of the interactions scaled to 0..1 within each; games that don't vary count 0."""
    game = Window.partitionBy("game_id")
    low, high = F.min("value").over(game), F.max("value").over(game)
    rows = pairs.select("i", "j", F.when(high > low, (F.col("value") - low) / (high - low)).otherwise(F.lit(0.0)).alias("value"))
    return rows.groupBy("i", "j").agg(F.avg("value").alias("value"))


def agreement_matrix(attributions: DataFrame, k: int = 3) -> DataFrame:
    """(left, right, spearman, kendall, overlap): means over games for each two utilities; `attributions` has provider."""
    one, two = (attributions.select("game_id", "item_idx", F.col("provider").alias(s), F.col("phi").alias(c)) for s, c in (("left", "pred"), ("right", "truth")))
    both, keys = one.join(two, ["game_id", "item_idx"]).where(F.col("left") < F.col("right")), ["left", "right", "game_id"]
    found = spearman(both, keys).withColumnRenamed("value", "spearman").join(kendall(both, keys).withColumnRenamed("value", "kendall"), keys).join(top_overlap(both, keys, k).withColumnRenamed("value", "overlap"), keys)
    return found.groupBy("left", "right").agg(*(F.avg(c).alias(c) for c in ("spearman", "kendall", "overlap")))


def interaction_agreement_matrix(interactions: DataFrame, k: int = 3, share: float = 0.1) -> DataFrame:
    """(left, right, spearman, overlap, n_strong, sign_agree, weak_frac): means over games for each two providers of
    `interactions` (game_id, provider, i, j, value). Ranks and the k largest are by size; signs are compared where both
    sides are strong, and games without such pairs have no part in their mean. Pairs that one side lacks, or whose value
    is null, are left out."""
    pair = F.struct("i", "j").alias("pair")
    one, two = (interactions.where("value is not null").select("game_id", pair, F.col("provider").alias(s), F.col("value").cast("double").alias(c)) for s, c in (("left", "pred"), ("right", "truth")))
    both, keys = one.join(two, ["game_id", "pair"]).where(F.col("left") < F.col("right")), ["left", "right", "game_id"]
    sizes = both.select(*keys, F.abs("pred").alias("pred"), F.abs("truth").alias("truth"))
    found = sign_agreement(both, keys, share).join(spearman(sizes, keys).withColumnRenamed("value", "spearman"), keys).join(top_overlap(both, keys, k, "pair").withColumnRenamed("value", "overlap"), keys)
    return found.groupBy("left", "right").agg(*(F.avg(c).alias(c) for c in ("spearman", "overlap", "n_strong", "sign_agree", "weak_frac")))
