"""Queries over sparse transforms, proxies, sampled interactions, patterns of any order, positions, medians and the stored
vector index, each with its SQL beside it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import bits
from tessera.operators import exact, metrics, sparse, stats, tuning, vector_index, walks
from tessera.plans import games
from tessera.plans import oracles as o
from tessera.plans import queries as core
from tessera.plans.games import table
from tessera.plans.inputs import query as registered
from tessera.plans.inputs import wide_games
from tessera.sources.scratch import scratch_dir

QUERIES: dict[str, core.Query] = {}
ORACLE: dict[str, str] = {}
rounded, r = core.rounded, o.r

#: Accounts of a nation that are patterns of its game, and coalitions that are asked for where a few are drawn.
ACCOUNTS, FEW = 4, 20


def query(sql: str | None = None):
    return registered(sql, QUERIES, ORACLE)


def account_patterns(spark, sf) -> DataFrame:
    """(game_id, subset, coef): the richest accounts of each nation as patterns of two or three of 21 to 40 items: a game
    whose few patterns are known."""
    own = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("game_id"), F.col("c_acctbal").cast("double").alias("coef"))
    best = own.withColumn("at", F.row_number().over(Window.partitionBy("game_id").orderBy(F.col("coef").desc(), "c_custkey"))).where(F.col("at") <= ACCOUNTS)
    rows = best.join(wide_games(spark, sf), "game_id")
    key, n = F.col("c_custkey").cast("bigint"), F.col("n_items")
    third = F.when(key % 2 == 1, bits.bit(F.floor(key / 5) % n)).otherwise(F.lit(0).cast("bigint"))
    rows = rows.select("game_id", bits.bit(key % n).bitwiseOR(bits.bit((key * 7 + 3) % n)).bitwiseOR(third).alias("subset"), "coef")
    return rows.groupBy("game_id", "subset").agg(F.sum("coef").alias("coef"))


@query(f"""WITH s AS (SELECT n_nationkey::BIGINT AS game_id, (21 + n_nationkey % 20)::INT AS n FROM nation), best AS (SELECT c_custkey::BIGINT AS k, c_nationkey::BIGINT AS game_id, c_acctbal::DOUBLE AS coef FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= {ACCOUNTS})
SELECT game_id, (1::BIGINT << (k % n)::INT) | (1::BIGINT << ((k * 7 + 3) % n)::INT) | (CASE WHEN k % 2 = 1 THEN 1::BIGINT << ((k // 5) % n)::INT ELSE 0 END) AS subset, {r('sum(coef)', 'coef', 4)} FROM best JOIN s USING (game_id) GROUP BY 1, 2""")
def sparse_patterns(spark, sf):
    """Patterns of wide games, found again from some thousand of their 2**21 to 2**40 coalitions."""
    planted = core.kept(account_patterns(spark, sf), "patterns")
    provider = lambda asked: sparse.predict_patterns(planted, asked).withColumnRenamed("predicted", "value")
    found = sparse.to_mobius(sparse.sparse_transform(wide_games(spark, sf).join(planted.select("game_id").distinct(), "game_id", "left_semi"), provider))
    return rounded(found.where(F.abs("coef") > 1e-3), 4)


@query(f"WITH {o.G4}, {o.MOBIUS} SELECT game_id, subset, {r('coef', 'coef')} FROM mob WHERE abs(coef) > 1e-6")
def tree_proxy(spark, sf):
    """One tree deep enough to tell all coalitions apart: the coefficients along its paths are the game's own."""
    leaves = sparse.boosted_leaves(games.event_game(spark, sf), trees=1, depth=games.TYPES, rate=1.0)
    return rounded(sparse.tree_coefficients(leaves).where(F.abs("coef") > 1e-6))


WHOLE = f"WITH {o.G4}, {o.SHAPLEY}, {o.SII} SELECT game_id, 1::BIGINT << item_idx AS subset, {r('phi', 'value')}, 0.0::DOUBLE AS variance FROM shap UNION ALL SELECT game_id, (1::BIGINT << i) | (1::BIGINT << j), {r('value', 'value')}, 0.0 FROM sii"


@query(WHOLE)
def interactions_whole(spark, sf):
    """With a budget for all coalitions nothing is drawn: Shapley values and interactions as they are."""
    u = core.kept(games.event_game(spark, sf), "utilities")
    drawn = sparse.by_size(games.games(u), 1 << games.TYPES).join(u.select("game_id", "mask", "value"), ["game_id", "mask"])
    return rounded(sparse.interactions(drawn))


@query(f"""WITH {o.G4}, z AS (SELECT game_id, mask, value, bit_count(mask)::INT AS z, row_number() OVER (PARTITION BY game_id, bit_count(mask) ORDER BY {o.unit("'42:stratum'", 'game_id', 'mask')}, mask) AS nth FROM u),
d AS (SELECT * FROM (SELECT *, CASE z WHEN 0 THEN 1 WHEN 5 THEN 1 WHEN 1 THEN 5 WHEN 4 THEN 5 ELSE 10 END AS stratum, CASE z WHEN 0 THEN 1 WHEN 5 THEN 1 WHEN 1 THEN 5 WHEN 4 THEN 5 ELSE 4 END AS drawn FROM z) WHERE nth <= drawn),
k AS (SELECT s::BIGINT AS subset, bit_count(s)::INT AS k FROM range(1, 32) r(s) WHERE bit_count(s) <= 2), c AS (SELECT d.*, subset, k, bit_count(mask & subset)::INT AS i, z - bit_count(mask & subset)::INT AS s FROM d, k),
t AS (SELECT *, value * (CASE WHEN (k - i) % 2 = 1 THEN -1 ELSE 1 END) * {o.fact('s')} * {o.fact('(5 - k - s)')} / {o.fact('(6 - k)')} AS term FROM c), p AS (SELECT game_id, subset, z, stratum, drawn, avg(term) AS mean, var_samp(term) AS v FROM t GROUP BY ALL)
SELECT game_id, subset, {r('sum(stratum * mean)', 'value')}, {r('sum(CASE WHEN drawn = stratum THEN 0 ELSE stratum * (stratum - drawn) * v / drawn END)', 'variance')} FROM p GROUP BY game_id, subset""")
def interactions_sampled(spark, sf):
    """With 20 coalitions of 32: sizes 0, 1, 4 and 5 whole, four of each of the sizes between."""
    u = core.kept(games.event_game(spark, sf), "utilities")
    drawn = sparse.by_size(games.games(u), FEW).join(u.select("game_id", "mask", "value"), ["game_id", "mask"])
    return rounded(sparse.interactions(drawn))


@query(f"WITH {o.G4}, {o.MOBIUS} SELECT u.game_id, n_items, u.mask, {r('sum(coef)', 'predicted')} FROM u JOIN mob ON mob.game_id = u.game_id AND (mob.subset & u.mask) = mob.subset AND mob.s <> 2 GROUP BY 1, 2, 3")
def predicted_any_order(spark, sf):
    """Predictions of patterns of none, one, three, four and five items."""
    u = core.kept(games.event_game(spark, sf), "utilities")
    coefs = exact.mobius(u).where(bits.size(F.col("subset")) != 2).select("game_id", "subset", "coef")
    return rounded(sparse.predict_patterns(coefs, u))


def stations(spark, sf) -> DataFrame:
    """(game_id, gone, position, token, p): hours() of two answer positions, the first and the second half of the day."""
    from tessera.plans.inputs import hours

    rows = hours(spark, sf).withColumn("position", F.floor(F.col("token") / 12).cast("int"))
    return rows.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("game_id", "gone", "position")))


@query(f"""WITH ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS item FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL) QUALIFY item < 5),
e AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE) AS game_id, hour(ts) AS token, hour(ts) // 12 AS half, item, gone FROM events JOIN ty USING (event_type), (VALUES (0), (1), (2), (3), (4), (8), (16)) g(gone) WHERE (gone >> item::INT) & 1 = 0),
c AS (SELECT game_id, gone, half, token, count(*) AS n FROM e GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY game_id, gone, half) AS p FROM c),
b AS (SELECT coalesce(s.game_id, x.game_id) AS game_id, coalesce(s.gone, x.gone) AS gone, coalesce(s.half, x.half) AS half, coalesce(x.p, 0) + 1e-10 AS p, coalesce(s.p, 0) + 1e-10 AS q FROM (SELECT g.game_id, g.gone, f.half, f.token, f.p FROM (SELECT DISTINCT game_id, gone FROM p WHERE gone <> 0) g JOIN p f ON f.game_id = g.game_id AND f.gone = 0) s FULL JOIN (SELECT * FROM p WHERE gone <> 0) x ON x.game_id = s.game_id AND x.gone = s.gone AND x.token = s.token),
k AS (SELECT game_id, gone, half, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM b WINDOW w AS (PARTITION BY game_id, gone, half)), j AS (SELECT game_id, gone, sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2 AS jsd FROM k GROUP BY 1, 2)
SELECT game_id, gone::BIGINT AS gone, {r('jsd', 'jsd')}, {r('1 - exp(-jsd)', 'gain')} FROM j""")
def jsd_of_positions(spark, sf):
    """Divergences of two answer positions, added up."""
    return rounded(exact.divergence_of_sets(stations(spark, sf)))


@query(f"WITH {o.METRIC} SELECT metric, method, budget, count(*) AS n, {r('median(value)', 'point')} FROM mr GROUP BY 1, 2, 3")
def bootstrap_medians(spark, sf):
    """Medians as the bootstrap finds them, by ranges of values: the cell itself is one of its resamples."""
    return rounded(stats.bootstrap_ci(core.metric_rows(spark, sf), stats.CELL, stat="median", times=200).select(*stats.CELL, "n", "point"))


@query(o.ORACLE["knn_l2"])
def knn_index(spark, sf):
    """knn_l2 from a stored index, which reads the cells that can have a neighbour."""
    from tessera.functions.utilities import unit_vector

    path = scratch_dir(spark, "vector-index")
    vectors = table(spark, sf, "embeddings").withColumn("embedding", unit_vector(F.col("embedding")))
    vector_index.build(vectors, path)
    asked = vectors.where(F.col("vec_id") % games.QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_index.search(spark, path, asked, 5)
    return rounded(found.select("query_id", "vec_id", (F.col("place") - 1).alias("item_idx"), "distance"), 5)


def truncated_sql(tolerance: float, budget: int) -> str:
    """Walks in turn: from where one is near the top its steps are 0; the first lookup that is one too many ends the game."""
    return f"""WITH {o.G4}, {o.DAYS}, {o.ORDER}, st AS (SELECT x.game_id, n, iteration, position, item, before | (1::BIGINT << item::INT) AS after, a.value AS last, b.value - a.value AS delta, t.value AS top FROM steps x JOIN u a ON a.game_id = x.game_id AND a.mask = before JOIN u b ON b.game_id = x.game_id AND b.mask = before | (1::BIGINT << item::INT) JOIN u t ON t.game_id = x.game_id AND t.mask = (1 << n) - 1),
cuts AS (SELECT *, bool_or(iteration > 1 AND abs(top - last) < {tolerance}) OVER (PARTITION BY game_id, iteration ORDER BY position) AS cut FROM st), firsts AS (SELECT *, NOT cut AND position < n - 1 AND row_number() OVER (PARTITION BY game_id, after, cut ORDER BY iteration, position) = 1 AS new FROM cuts),
spends AS (SELECT *, sum(new::INT) OVER (PARTITION BY game_id ORDER BY iteration, position) AS spent FROM firsts), made AS (SELECT * FROM spends WHERE spent <= {budget - 2}), e AS (SELECT game_id, 2 + max(spent)::BIGINT AS evaluations FROM made GROUP BY 1)
SELECT game_id, item::INT AS item_idx, {r('avg(CASE WHEN cut THEN 0 ELSE delta END)', 'phi')}, max(evaluations) AS evaluations FROM made JOIN e USING (game_id) GROUP BY game_id, item"""


ORACLE["tmc_shapley"] = truncated_sql(5.0, 20)


@query(truncated_sql(5.0, 20))
def tmc_stepwise(spark, sf):
    """Truncated walks that ask a scorer, here one that looks the games up, for what they get to."""
    u = core.kept(games.event_game(spark, sf), "utilities")
    found = lambda asked: asked.join(u.select("game_id", "mask", "value"), ["game_id", "mask"])
    return rounded(walks.step_walks(games.games(u), found, core.ORDERS, 5.0, 20, core.SEED))


#: The linear part of joint tuning: blends, folds, and the penalty that makes what differences don't settle 0.
BETAS, FOLDS, PENALTY = (0.0, 0.5, 1.0), 4, 0.001


def blended_hat(beta: float, fold: int, n: int = games.TYPES) -> np.ndarray:
    """Coefficients by utilities of coalitions: row 0 the intercept, row i + 1 item i, of the fit to pairs (m, m with item
    m % n flipped) that aren't in the fold."""
    sides = [(m, m ^ 1 << m % n) for m in range(1 << n) if m % FOLDS != fold]
    pick = np.eye(1 << n)[[m for pair in sides for m in pair]]
    x = np.array([[1.0, *((m >> i & 1) for i in range(n))] for m in range(1 << n)])
    x = pick @ x
    apart = lambda z: z[1::2] - z[::2]
    gram = (1 - beta) * x.T @ x / len(x) + beta * apart(x).T @ apart(x) / len(sides) + np.diag([0.0] + [PENALTY] * n)
    right = (1 - beta) * x.T @ pick / len(x) + beta * apart(x).T @ apart(pick) / len(sides)
    if beta < 1:
        return np.linalg.solve(gram, right)
    items = np.linalg.solve(gram[1:, 1:], right[1:])
    return np.vstack([pick.mean(0) - x[:, 1:].mean(0) @ items, items])


def tuning_sql() -> str:
    hats = ",".join(f"({b},{f},{k},{m},{h!r})" for b in BETAS for f in range(FOLDS) for k, row in enumerate(blended_hat(b, f).tolist()) for m, h in enumerate(row))
    z = lambda y, p: f"CASE WHEN stddev_pop({y}) > 1e-12 AND stddev_pop({p}) > 1e-12 THEN 2 - 2 * covar_pop({y}, {p}) / (stddev_pop({y}) * stddev_pop({p})) WHEN stddev_pop({y}) > 1e-12 OR stddev_pop({p}) > 1e-12 THEN 1 ELSE 0 END"
    return f"""WITH {o.G4}, h(beta, fold, k, mask, h) AS (VALUES {hats}), co AS (SELECT game_id, beta::DOUBLE AS beta, fold, k, sum(h::DOUBLE * value) AS c FROM u JOIN h ON h.mask = u.mask GROUP BY ALL),
p AS (SELECT u.game_id, beta, fold, u.mask, any_value(value) AS y, sum(CASE WHEN k = 0 OR (u.mask >> greatest(k - 1, 0)::INT) & 1 = 1 THEN c ELSE 0 END) AS p FROM u JOIN co ON co.game_id = u.game_id GROUP BY 1, 2, 3, 4),
d AS (SELECT a.game_id, a.beta, a.fold, a.y, a.p, b.y AS y2, b.p AS p2 FROM p a JOIN p b ON a.game_id = b.game_id AND a.beta = b.beta AND a.fold = b.fold AND a.mask % {FOLDS} = a.fold AND b.mask = xor(a.mask, 1::BIGINT << (a.mask % {games.TYPES})::INT)),
l AS (SELECT game_id, beta, fold, y, p FROM d UNION ALL SELECT game_id, beta, fold, y2, p2 FROM d), e AS (SELECT game_id, beta, fold, avg((y - p) ** 2) AS um, {z('y', 'p')} AS uz FROM l GROUP BY 1, 2, 3),
f AS (SELECT game_id, beta, fold, avg((y2 - y - p2 + p) ** 2) AS dm, {z('y2 - y', 'p2 - p')} AS dz FROM d GROUP BY 1, 2, 3)
SELECT game_id, fold::INT AS fold, 0::INT AS rank, beta, {r('um', 'util_mse', 4)}, {r('dm', 'delta_mse', 4)}, {r('uz', 'util_z', 4)}, {r('dz', 'delta_z', 4)} FROM e JOIN f USING (game_id, beta, fold)"""


def mask_pairs(utilities: DataFrame) -> DataFrame:
    """Every coalition m and its copy with item m % n flipped, as pairs with values."""
    both = F.array(F.col("mask"), F.col("mask").bitwiseXOR(bits.bit(F.col("mask") % F.col("n_items"))))
    sides = utilities.select("game_id", "n_items", F.col("mask").alias("pair"), F.posexplode(both).alias("side", "mask"))
    return sides.join(utilities.select("game_id", "mask", "value"), ["game_id", "mask"])


@query(tuning_sql())
def tuning_folds(spark, sf):
    """Held-out errors by fold and blend of the linear part, which has a closed form."""
    pairs = mask_pairs(core.kept(games.event_game(spark, sf), "utilities"))
    return rounded(tuning.tuning_scores(pairs, (0,), BETAS, FOLDS, l2_w=PENALTY, rounds=5000), 4)


@query()
def tuned_machine(spark, sf):
    """Coefficients of the machines that are chosen on z-scored errors; tests/test_tuning.py holds choice and fit against known games."""
    pairs = core.kept(mask_pairs(games.segment_game(spark, sf)), "pairs")
    chosen = tuning.choose(tuning.tuning_scores(pairs, (1, 2), (0.0, 0.5), rounds=100), zscored=True)
    return rounded(tuning.fit_tuned(pairs, chosen))


PAIRED = "PARTITION BY a, b, game_id"


@query(f"""WITH {o.G4}, {o.SII}, {o.BII}, {o.MOBIUS}, v AS (SELECT 'banzhaf' AS provider, game_id, i, j, round(value, 9) AS value FROM bii UNION ALL SELECT 'shapley', game_id, i, j, round(value, 9) FROM sii UNION ALL SELECT 'mobius', game_id, x.i, y.j, round(coef, 9) FROM mob, range(5) x(i), range(5) y(j) WHERE x.i < y.j AND subset = (1::BIGINT << x.i::INT) | (1::BIGINT << y.j::INT)),
sc AS (SELECT l.provider AS a, q.provider AS b, l.game_id, l.i, l.j, l.value AS pred, q.value AS truth FROM v l JOIN v q ON l.game_id = q.game_id AND l.i = q.i AND l.j = q.j AND l.provider < q.provider),
w AS (SELECT *, rank() OVER ({PAIRED} ORDER BY abs(pred)) + (count(*) OVER ({PAIRED}, abs(pred)) - 1) / 2.0::DOUBLE AS p, rank() OVER ({PAIRED} ORDER BY abs(truth)) + (count(*) OVER ({PAIRED}, abs(truth)) - 1) / 2.0::DOUBLE AS t, row_number() OVER ({PAIRED} ORDER BY abs(pred) DESC, i, j) <= 3 AND row_number() OVER ({PAIRED} ORDER BY abs(truth) DESC, i, j) <= 3 AS shared_top, max(abs(pred)) OVER ({PAIRED}) AS mp, max(abs(truth)) OVER ({PAIRED}) AS mt FROM sc),
s AS (SELECT *, mp > 0 AND mt > 0 AND abs(pred) >= 0.1::DOUBLE * mp AND abs(truth) >= 0.1::DOUBLE * mt AS strong FROM w),
g AS (SELECT a, b, game_id, CASE WHEN stddev_pop(p) > 0 AND stddev_pop(t) > 0 THEN corr(p, t) END AS sp, count(*) FILTER (WHERE shared_top) / 3.0::DOUBLE AS ov, count(*) FILTER (WHERE strong) AS n, avg((sign(pred) = sign(truth))::INT) FILTER (WHERE strong) AS same, 1 - count(*) FILTER (WHERE strong) / count(*) AS weak FROM s GROUP BY ALL)
SELECT a AS "left", b AS "right", {r('avg(sp)', 'spearman')}, {r('avg(ov)', 'overlap')}, {r('avg(n)', 'n_strong')}, {r('avg(same)', 'sign_agree')}, {r('avg(weak)', 'weak_frac')} FROM g GROUP BY 1, 2""")
def interaction_agreement(spark, sf):
    """How three indices of pairs agree: ranks and the largest by size, signs where both are strong."""
    u = core.kept(games.event_game(spark, sf), "utilities")
    two = exact.mobius(u).where(bits.size(F.col("subset")) == 2).select("game_id", bits.members(F.col("subset"), F.lit(games.TYPES)).alias("m"), F.col("coef").alias("value"))
    of = {"banzhaf": exact.banzhaf_interactions(u), "shapley": exact.shapley_interactions(u), "mobius": two.select("game_id", F.get("m", F.lit(0)).alias("i"), F.get("m", F.lit(1)).alias("j"), "value")}
    rows = [v.select("game_id", F.lit(name).alias("provider"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("value", 9).alias("value")) for name, v in of.items()]
    return rounded(metrics.interaction_agreement_matrix(rows[0].unionByName(rows[1]).unionByName(rows[2])))
