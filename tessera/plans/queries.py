"""The engine's queries on the test tables: each takes (spark, sf_dir). Doubles are rounded, so that engines agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import bits, kernels, text, utilities
from tessera.operators import coalitions, exact, metrics, permutations, prepare, stats, surrogates
from tessera.plans import ablation, games
from tessera.plans.games import table
from tessera.sources.scratch import kept, scratch_dir
from tessera.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
GAME = ["game_id"]
BUDGET, SEED, ORDERS = 16, 42, 20


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


# Games


@query
def g1_utilities(spark, sf):
    return rounded(games.supplier_game(spark, sf))


@query
def g2_utilities(spark, sf):
    return rounded(games.turn_game(spark, sf))


@query
def g3_utilities(spark, sf):
    return rounded(games.segment_game(spark, sf))


@query
def g4_utilities(spark, sf):
    return rounded(games.event_game(spark, sf))


@query
def g5_retrieval(spark, sf):
    return rounded(games.retrieved(spark, sf).select("query_id", "vec_id", "item_idx", "pred", "truth"))


# Exact indices


@query
def exact_shapley(spark, sf):
    return rounded(exact.shapley(games.supplier_game(spark, sf)))


@query
def shapley_conversations(spark, sf):
    return rounded(exact.shapley(games.turn_game(spark, sf)))


@query
def exact_banzhaf(spark, sf):
    return rounded(exact.banzhaf(games.event_game(spark, sf)))


@query
def sii_pairs(spark, sf):
    return rounded(exact.shapley_interactions(games.event_game(spark, sf)))


@query
def banzhaf_pairs(spark, sf):
    return rounded(exact.banzhaf_interactions(games.event_game(spark, sf)))


@query
def mobius(spark, sf):
    return rounded(exact.mobius(games.event_game(spark, sf), games.TYPES).select("game_id", "subset", "coef"))


@query
def fsii_order2(spark, sf):
    return rounded(exact.faithful(exact.mobius(games.supplier_game(spark, sf), games.SUPPLIERS), "FSII", 2))


@query
def fbii_order2(spark, sf):
    return rounded(exact.faithful(exact.mobius(games.event_game(spark, sf), games.TYPES), "FBII", 2))


@query
def loo(spark, sf):
    return rounded(exact.leave_one_out(games.event_game(spark, sf)))


@query
def topk_exhaustive_removal(spark, sf):
    return rounded(exact.worst_removal(games.event_game(spark, sf), 2))


@query
def jsd(spark, sf):
    """Divergence of a day's event types from those of all days."""
    rows = table(spark, sf, "events").groupBy(F.unix_date(F.to_date("ts")).cast("bigint").alias("game_id"), "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    all_days = rows.groupBy("event_type").agg(F.sum("n").alias("all"))
    days = rows.select("game_id").distinct()
    if all_days.count() > games.MOST_TYPES:
        raise ValueError(f"more than {games.MOST_TYPES} event types")
    own = days.crossJoin(F.broadcast(all_days)).join(rows, ["game_id", "event_type"], "left")
    day = Window.partitionBy("game_id")
    dists = own.select("game_id", (F.coalesce("n", F.lit(0.0)) / F.sum(F.coalesce("n", F.lit(0.0))).over(day)).alias("p"), (F.col("all") / F.sum("all").over(day)).alias("q"))
    return rounded(exact.jensen_shannon(dists, ["game_id"]).withColumn("utility", utilities.divergence_utility(F.col("jsd"))))


# Samplers


def event_sizes(spark, sf) -> DataFrame:
    return games.games(games.event_game(spark, sf))


def turn_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """A game for each conversation, with its turns as items."""
    turns = table(spark, sf, "conversations").where("conv_id is not null")
    return turns.groupBy(F.col("conv_id").cast("bigint").alias("game_id")).agg(F.count(F.lit(1)).cast("int").alias("n_items"))


@query
def powerset(spark, sf):
    return coalitions.powerset(turn_sizes(spark, sf)).select("game_id", "mask")


def _sampled(method: str) -> Query:
    return lambda spark, sf: coalitions.sample(turn_sizes(spark, sf), 40, method, SEED).select("game_id", "mask", "ord")


QUERIES |= {f"sample_{m}": _sampled(m) for m in ("uniform", "kernelshap", "bf", "bf_uniform", "bf_kernelshap")}


@query
def structured_sample(spark, sf):
    return coalitions.structured_sample(turn_sizes(spark, sf), 40, core=False, neighbours=True, fill="size_uniform", seed=SEED).select("game_id", "mask", "ord")


@query
def structured_truncated(spark, sf):
    return coalitions.structured_sample(turn_sizes(spark, sf), 9, fill="none").select("game_id", "mask", "ord")


@query
def pool_uniform(spark, sf):
    return coalitions.pool_sample(games.event_game(spark, sf), BUDGET, seed=SEED).select("game_id", "mask", "ord")


@query
def pool_kernel_weighted(spark, sf):
    return coalitions.pool_sample(games.event_game(spark, sf), BUDGET, True, SEED).select("game_id", "mask", "ord")


@query
def paired_coalitions(spark, sf):
    return coalitions.paired_coalitions(turn_sizes(spark, sf), 30, SEED)


@query
def flip_expand(spark, sf):
    return coalitions.flip_expand(coalitions.sample(turn_sizes(spark, sf), 10, "uniform", SEED), SEED).select("game_id", "mask")


@query
def random_permutations(spark, sf):
    return coalitions.permutations(turn_sizes(spark, sf), ORDERS, SEED).select("game_id", "iteration", "position", "item_idx", "mask_before")


def kernel_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """(n, z): every size of an order or a conversation, with the sizes of its coalitions."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    sizes = lines.select("n").union(turn_sizes(spark, sf).select("n_items")).distinct()
    return sizes.select("n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("z"))


@query
def kernel_weights(spark, sf):
    rows = kernel_sizes(spark, sf)
    n, z = F.col("n"), F.col("z")
    inner = z < n
    return rounded(rows.select("n", "z", kernels.shap_kernel(n, z).alias("shap"), kernels.shap_kernel(n, z, 1000.0).alias("ends"), kernels.size_kernel(n, z).alias("sized"), F.when(inner, kernels.shapley_weight(n, F.when(inner, z).otherwise(F.lit(0)))).alias("shapley"), F.when(z <= n - 2, kernels.pair_weight(n, F.when(z <= n - 2, z).otherwise(F.lit(0)))).alias("pair"), F.when(inner, kernels.beta_weight(n, z, 16.0, 1.0)).alias("beta")))


@query
def hamming1_pairs(spark, sf):
    return coalitions.hamming1_pairs(coalitions.sample(event_sizes(spark, sf), BUDGET, "kernelshap", SEED)).select("game_id", "item_idx", "mask_without", "mask_with")


# Orders


@query
def beta_shapley(spark, sf):
    u = games.event_game(spark, sf)
    return rounded(permutations.beta_shapley(games.games(u), u, ORDERS, 4.0, 1.0, SEED))


@query
def tmc_shapley(spark, sf):
    u = games.event_game(spark, sf)
    return rounded(permutations.truncated_shapley(games.games(u), u, ORDERS, 5.0, 20, SEED))


@query
def tmc_untruncated(spark, sf):
    """Without tolerance and budget the running mean is that of all marginals."""
    u = games.event_game(spark, sf)
    return rounded(permutations.truncated_shapley(games.games(u), u, ORDERS, 0.0, None, SEED).select("game_id", "item_idx", "phi"))


# Metrics


def item_scores(spark, sf) -> DataFrame:
    """Leave-one-out as an estimate of Shapley values."""
    u = games.event_game(spark, sf)
    return exact.leave_one_out(u).withColumnRenamed("phi", "pred").join(exact.shapley(u).withColumnRenamed("phi", "truth"), ["game_id", "item_idx"]).select("game_id", "item_idx", F.round("pred", 9).alias("pred"), F.round("truth", 9).alias("truth"))


def pair_scores(spark, sf, absolute: bool = False) -> DataFrame:
    u = games.event_game(spark, sf)
    pred, truth = exact.banzhaf_interactions(u).withColumnRenamed("value", "pred"), exact.shapley_interactions(u).withColumnRenamed("value", "truth")
    both = pred.join(truth, ["game_id", "i", "j"])
    side = lambda c: (F.abs(F.round(c, 9)) if absolute else F.round(c, 9)).alias(c)
    return both.select("game_id", (F.col("i") * 64 + F.col("j")).alias("item_idx"), side("pred"), side("truth"))


def coalition_scores(spark, sf) -> DataFrame:
    """Utilities and the sum of the members' leave-one-out values."""
    u = games.event_game(spark, sf)
    phi = exact.leave_one_out(u).groupBy("game_id").agg(F.map_from_entries(F.collect_list(F.struct("item_idx", "phi"))).alias("by"))
    add = F.aggregate(bits.members(F.col("mask"), F.col("n_items")), F.lit(0.0), lambda s, i: s + F.col("by")[i])
    return u.join(phi, "game_id").select("game_id", "n_items", "mask", F.round(add, 9).alias("pred"), F.round("value", 9).alias("truth"))


@query
def pearson(spark, sf):
    return rounded(metrics.pearson(item_scores(spark, sf), GAME))


@query
def lds_spearman(spark, sf):
    return rounded(metrics.spearman(coalition_scores(spark, sf), GAME))


@query
def kendall_tau_b(spark, sf):
    return rounded(metrics.kendall(item_scores(spark, sf), GAME))


@query
def r2_util(spark, sf):
    return rounded(metrics.r2(coalition_scores(spark, sf), GAME))


@query
def delta_r2(spark, sf):
    return rounded(metrics.r2(metrics.delta_scores(coalition_scores(spark, sf)), GAME))


@query
def ndcg_at_k(spark, sf):
    return rounded(metrics.ndcg(item_scores(spark, sf), GAME, 3))


@query
def ndcg_inter_at_k(spark, sf):
    return rounded(metrics.ndcg(pair_scores(spark, sf, True), GAME, 5, shift=False))


@query
def average_precision(spark, sf):
    return rounded(metrics.average_precision(games.retrieved(spark, sf), ["query_id"]))


@query
def recall_at_k(spark, sf):
    return rounded(metrics.recall_at(games.retrieved(spark, sf), ["query_id"], 3))


@query
def precision_at_gt(spark, sf):
    return rounded(metrics.precision_at_gold(games.retrieved(spark, sf), ["query_id"]))


def attributed(spark, sf) -> tuple[DataFrame, DataFrame]:
    u = games.event_game(spark, sf)
    return exact.shapley(u).withColumn("phi", F.round("phi", 9)), u


@query
def topk_drop(spark, sf):
    return rounded(metrics.top_k_drop(*attributed(spark, sf), 2))


@query
def topk_only_utility(spark, sf):
    return rounded(metrics.top_k_only(*attributed(spark, sf), 2))


def interactions(spark, sf) -> DataFrame:
    return exact.shapley_interactions(games.event_game(spark, sf)).withColumn("value", F.round("value", 9))


def gold(pairs: DataFrame) -> DataFrame:
    """Items 0, 1 and 2 of every game."""
    return pairs.select("game_id").distinct().select("game_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("item_idx"))


@query
def rr_at_k(spark, sf):
    pairs = interactions(spark, sf)
    return rounded(metrics.pair_recovery(pairs, gold(pairs), 3))


@query
def pair_recall_at_k(spark, sf):
    pairs = interactions(spark, sf)
    return rounded(metrics.pair_recall(pairs, gold(pairs), 3))


@query
def extreme_pair(spark, sf):
    pairs = interactions(spark, sf)
    return rounded(metrics.extreme_pair(pairs, 0, 1).withColumn("side", F.lit("max")).unionByName(metrics.extreme_pair(pairs, 0, 1, False).withColumn("side", F.lit("min"))))


@query
def topk_overlap(spark, sf):
    return rounded(metrics.top_overlap(item_scores(spark, sf), GAME, 2))


@query
def sign_agreement(spark, sf):
    return rounded(metrics.sign_agreement(pair_scores(spark, sf), GAME))


@query
def correctness_split(spark, sf):
    pairs = interactions(spark, sf)
    return rounded(metrics.correctness_split(pairs, pairs.select("game_id").distinct().withColumn("correct", F.col("game_id") % 2 == 0)))


@query
def minmax_mean_matrix(spark, sf):
    return rounded(metrics.mean_scaled(interactions(spark, sf)))


@query
def agreement_matrix(spark, sf):
    u = kept(games.event_game(spark, sf), "utilities")
    both = [f(u).withColumn("phi", F.round("phi", 9)).withColumn("provider", F.lit(n)) for n, f in (("banzhaf", exact.banzhaf), ("loo", exact.leave_one_out), ("shapley", exact.shapley))]
    return rounded(metrics.agreement_matrix(both[0].unionByName(both[1]).unionByName(both[2]), 2))


# Surrogates


@query
def linear_fit(spark, sf):
    """The linear fit to all coalitions, alike weighted, has the Banzhaf values as slopes."""
    return rounded(surrogates.fit_least_squares(games.event_game(spark, sf)))


@query
def poly2_fit(spark, sf):
    """A pairwise fit gives back a game of order two."""
    return rounded(rounded(surrogates.fit_least_squares(games.segment_game(spark, sf), 2), 10))  # coefficients are right to 1e-12: ties at six digits are ties again


def weighted_train(spark, sf) -> DataFrame:
    u = games.event_game(spark, sf)
    return u.withColumn("weight", kernels.shap_kernel(F.col("n_items"), bits.size(F.col("mask")), 1000.0))


@query
def fm_als(spark, sf):
    return rounded(surrogates.fit_fm(games.segment_game(spark, sf), 4, l2_w=1e-6, l2_v=1e-4), 3)


@query
def fm_rank(spark, sf):
    """The candidate ranks of each game, what they are judged by, and which is chosen."""
    return rounded(surrogates.select_rank(games.segment_game(spark, sf), rounds=40), 3)


@query
def fm_attributions(spark, sf):
    effects, pairs = games.segment_effects(spark, sf)
    coefs = effects.select("game_id", bits.bit(F.col("item_idx")).alias("subset"), F.col("w").alias("coef")).unionByName(pairs.select("game_id", bits.bit(F.col("i")).bitwiseOR(bits.bit(F.col("j"))).alias("subset"), F.col("value").alias("coef")))
    return rounded(surrogates.attributions(coefs))


@query
def hybrid_wss(spark, sf):
    """True utilities of half of the coalitions, the linear fit's elsewhere."""
    u = games.event_game(spark, sf)
    known = u.where(F.bit_count("mask") % 2 == 0)
    return rounded(surrogates.hybrid_shapley(surrogates.fit_least_squares(u), known, games.games(u), coalitions.powerset))


@query
def prune_topq(spark, sf):
    return rounded(surrogates.prune_interactions(interactions(spark, sf), "topq", 0.25))


@query
def prune_mad(spark, sf):
    return rounded(surrogates.prune_interactions(interactions(spark, sf), "thresh"))


@query
def ablation_grid(spark, sf):
    """All variants at a budget."""
    return rounded(ablation.grid(kept(games.event_game(spark, sf), "utilities"), [BUDGET]), 3)


# Text and preparation


def exchanges(spark, sf) -> DataFrame:
    """Each turn beside the one before it."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lag("text").over(by).alias("before"))


@query
def normalise_answer(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.normalise_answer(F.col("text")).alias("normal"))


@query
def exact_match(spark, sf):
    return exchanges(spark, sf).select("conv_id", "turn", text.exact_match(F.col("text"), F.col("before")).alias("em"))


@query
def token_f1(spark, sf):
    return rounded(exchanges(spark, sf).select("conv_id", "turn", text.token_f1(F.col("text"), F.col("before")).alias("f1")))


@query
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.clean(F.col("text"))).alias("cleaned"))


@query
def sentence_items(spark, sf):
    return prepare.sentence_items(table(spark, sf, "benchmark"), "item_id")


@query
def ablated_context(spark, sf):
    rows = games.conversations(spark, sf)
    return rows.select("game_id", prepare.ablated(F.col("texts"), F.lit(5).cast("bigint")).alias("context"), prepare.removed(F.size("texts"), F.array(F.lit(0))).alias("mask"))


@query
def gold_first_reorder(spark, sf):
    """A conversation's assistant turns first."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    gold_turns = F.filter(F.transform("t", lambda x, i: F.when(x["role"] == "assistant", i)), lambda i: i.isNotNull())
    return rows.select("conv_id", F.array_join(prepare.gold_first(F.transform("t", lambda x: x["text"]), gold_turns, 10), "\n").alias("texts"), F.size(gold_turns).alias("len_gt"))


@query
def duplicate_injection(spark, sf):
    return games.conversations(spark, sf).select("game_id", F.array_join(prepare.with_duplicate(F.col("texts"), 1, 5), "\n").alias("texts"))


@query
def lookup_conflicts(spark, sf):
    """The language of a source, where all of its documents agree."""
    docs = table(spark, sf, "documents")
    return prepare.lookup_answers(docs.select("source").distinct(), docs.select("source", "lang"), "source", "lang")


@query
def knn_l2(spark, sf):
    return rounded(games.retrieved(spark, sf, 5).select("query_id", "vec_id", "item_idx", (-F.col("pred")).alias("distance")), 5)


@query
def normalised_vectors(spark, sf):
    v = table(spark, sf, "embeddings")
    return rounded(v.select("vec_id", utilities.dot(F.col("embedding"), F.col("embedding")).alias("squared"), F.element_at(utilities.unit_vector(F.col("embedding")), 1).alias("first")), 5)


@query
def utility_modes(spark, sf):
    """All modes on the log-probability of a conversation's last turn under the words of the turns in a coalition."""
    rows = games.turn_log_probs(spark, sf)
    return rounded(rows.select("game_id", "mask", *(utilities.utility(m, F.col("lp"), F.col("lp_empty"), F.col("tokens")).alias(m.replace("-", "_")) for m in utilities.MODES)))


# Statistics


def metric_rows(spark, sf) -> DataFrame:
    """Orders as metric rows: customers are questions, priorities methods, years budgets; each with its highest price."""
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("method"), F.year("o_orderdate").alias("budget")).agg(F.max("o_totalprice").alias("value"))
    return rows.withColumn("metric", F.lit("price"))


BASE = "1-URGENT"
PAIR_KEYS = ["metric", "budget", "method"]


@query
def method_budget_parse(spark, sf):
    keys = table(spark, sf, "orders").select(F.concat_ws("_", "o_orderpriority", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 700)).alias("key")).distinct()
    return keys.select("key", stats.method_family(F.col("key")).alias("method"), stats.method_budget(F.col("key")).alias("budget"))


@query
def long_metrics(spark, sf):
    wide = table(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_acctbal") > 0, F.sqrt(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))).alias("root"))
    return rounded(stats.long_metrics(wide, ["qid"], ["balance", "root"]))


@query
def paired_align(spark, sf):
    return rounded(stats.aligned(metric_rows(spark, sf), BASE, "5-LOW"))


@query
def mean_nanstd(spark, sf):
    return rounded(stats.summary(metric_rows(spark, sf)))


@query
def variance_report(spark, sf):
    return rounded(stats.variance_report(metric_rows(spark, sf)))


@query
def win_tie_loss(spark, sf):
    return rounded(stats.win_tie_loss(stats.against(metric_rows(spark, sf), BASE), PAIR_KEYS))


@query
def signed_rank(spark, sf):
    return rounded(stats.signed_rank(stats.against(metric_rows(spark, sf), BASE), PAIR_KEYS))


@query
def wilcoxon(spark, sf):
    return rounded(stats.wilcoxon(stats.against(metric_rows(spark, sf), BASE), PAIR_KEYS))


@query
def holm(spark, sf):
    """On made-up p values, one for each nation, by region."""
    tests = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", ((F.col("n_nationkey") * 7 % 25 + 1) / 250.0).alias("p"))
    return rounded(stats.holm(tests, ["n_regionkey"]))


@query
def bootstrap_ci(spark, sf):
    return rounded(stats.bootstrap_ci(metric_rows(spark, sf), ["metric", "method", "budget"]), 3)


@query
def component_contributions(spark, sf):
    return rounded(stats.contributions(metric_rows(spark, sf), BASE), 3)


@query
def paired_correlation(spark, sf):
    return rounded(stats.paired_correlation(stats.against(metric_rows(spark, sf), BASE), PAIR_KEYS))


@query
def budget_table(spark, sf):
    return rounded(stats.budget_table(metric_rows(spark, sf), [1995, 1996, 1997]).withColumnsRenamed({str(y): f"y{y}" for y in (1995, 1996, 1997)}))


@query
def detectable_effect(spark, sf):
    """For each kind of event: the effect that as many pairs detect, and the pairs that an effect of 0.042 needs."""
    found = table(spark, sf, "events").groupBy("event_type").agg(F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
    return rounded(found.select("event_type", "n", stats.effect_of(F.col("sd"), F.col("n")).alias("effect"), stats.pairs_for(F.col("sd"), F.lit(0.042)).alias("pairs")), 4)


@query
def minmax_scaled(spark, sf):
    own = pair_scores(spark, sf)
    return rounded(prepare.scaled(own, GAME, ["pred", "truth"], "joint"))


# Streams


@query
def stream_coverage(spark, sf):
    """Event masks of the days that the watermark has closed, by a stream that ends when the input does."""
    schema = table(spark, sf, "events").schema
    types = [r["event_type"] for r in games.type_items(table(spark, sf, "events")).orderBy("item_idx").collect()]
    out = scratch_dir(spark, "stream-masks")
    stream.start(stream.reached(stream.read_events(spark, sf, schema), types), out, scratch_dir(spark, "stream-state")).awaitTermination()
    return stream.served(spark.read.parquet(out)).select("game_id", "m", "n")


