"""SQL for DuckDB that gives the queries' rows, written from the definitions and not from the plans: where the engine
adds up signed values once, this joins a coalition with its neighbours."""

from __future__ import annotations

from tessera.functions.text import BLANK, PUNCTUATION

G1 = """p AS (SELECT l_suppkey, row_number() OVER (ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, l_suppkey) - 1 AS item FROM lineitem GROUP BY l_suppkey QUALIFY item < 8),
served AS (SELECT l_orderkey, bit_or(1 << item::INT) AS m FROM lineitem JOIN p USING (l_suppkey) GROUP BY l_orderkey),
cover AS (SELECT m, count(*) AS n FROM served GROUP BY m),
u AS (SELECT 0::BIGINT AS game_id, 8 AS n_items, k.mask::BIGINT AS mask, ln(1 + coalesce(sum(n) FILTER (WHERE (m & k.mask) <> 0), 0)) AS value FROM range(256) k(mask), cover GROUP BY k.mask)"""
G4 = """ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS item FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL) QUALIFY item < 5),
reach AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE) AS game_id, user_id, bit_or(1 << item::INT) AS m FROM events JOIN ty USING (event_type) GROUP BY 1, 2),
cover AS (SELECT game_id, m, count(*) AS n FROM reach GROUP BY game_id, m),
u AS (SELECT game_id, 5 AS n_items, k.mask::BIGINT AS mask, coalesce(sum(n) FILTER (WHERE (m & k.mask) <> 0), 0)::DOUBLE AS value FROM range(32) k(mask), cover GROUP BY game_id, k.mask)"""


def tokens(expr: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower(coalesce({expr}, '')), '{PUNCTUATION}', '', 'g'), '{BLANK}'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"


def f1(shared: str, left: str, right: str) -> str:
    return f"CASE WHEN {left} = 0 AND {right} = 0 THEN 1.0::DOUBLE WHEN {left} = 0 OR {right} = 0 THEN 0.0 ELSE 2.0::DOUBLE * {shared} / ({left} + {right}) END"


TURNS = """turns AS (SELECT conv_id AS game_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS item, count(*) OVER (PARTITION BY conv_id) AS size FROM conversations),
held AS (SELECT * FROM turns WHERE size > 1)"""
G2 = f"""{TURNS},
tok AS (SELECT game_id, item, size, size - 1 AS n_items, item = size - 1 AS is_last, {tokens("text")} AS w FROM held),
one AS (SELECT game_id, item, unnest(w) AS w FROM tok WHERE NOT is_last),
gold AS (SELECT game_id, w, count(*) AS g FROM (SELECT game_id, unnest(w) AS w FROM tok WHERE is_last) GROUP BY ALL),
sz AS (SELECT game_id, n_items, len(w) AS gs FROM tok WHERE is_last),
masks AS (SELECT game_id, n_items, gs, unnest(range(1 << n_items::INT)) AS mask FROM sz),
lens AS (SELECT masks.game_id, mask, coalesce(sum(len(w)) FILTER (WHERE ((mask >> item::INT) & 1) = 1), 0) AS ls FROM masks JOIN tok ON masks.game_id = tok.game_id AND NOT is_last GROUP BY ALL),
cnt AS (SELECT masks.game_id, mask, one.w, count(*) AS c FROM masks JOIN one ON masks.game_id = one.game_id AND ((mask >> item::INT) & 1) = 1 GROUP BY ALL),
ov AS (SELECT cnt.game_id, mask, sum(least(c, g)) AS shared FROM cnt JOIN gold ON cnt.game_id = gold.game_id AND cnt.w = gold.w GROUP BY ALL),
u AS (SELECT masks.game_id, n_items, masks.mask, {f1("coalesce(shared, 0)", "ls", "gs")} AS value FROM masks JOIN lens USING (game_id, mask) LEFT JOIN ov USING (game_id, mask))"""
G3 = """seg AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS item FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL) QUALIFY item < 5),
own AS (SELECT c_nationkey::BIGINT AS game_id, item, max(c_acctbal) / 1000 AS w, count(*) AS n FROM customer JOIN seg USING (c_mktsegment) GROUP BY 1, 2),
eff AS (SELECT g.game_id, seg.item, coalesce(w, 0) AS w, coalesce(n, 0) AS n FROM (SELECT DISTINCT c_nationkey::BIGINT AS game_id FROM customer) g CROSS JOIN seg LEFT JOIN own ON own.game_id = g.game_id AND own.item = seg.item),
tot AS (SELECT game_id, sum(n) AS t FROM eff GROUP BY game_id),
prs AS (SELECT a.game_id, a.item AS i, b.item AS j, (CASE WHEN (a.item + b.item) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END) * a.n * b.n / (t * t) AS value FROM eff a JOIN eff b ON a.game_id = b.game_id AND a.item < b.item JOIN tot ON tot.game_id = a.game_id),
u AS (SELECT g.game_id, 5 AS n_items, k.mask::BIGINT AS mask, coalesce((SELECT sum(w) FROM eff WHERE eff.game_id = g.game_id AND ((k.mask >> item::INT) & 1) = 1), 0) + coalesce((SELECT sum(value) FROM prs WHERE prs.game_id = g.game_id AND ((k.mask >> i::INT) & 1) = 1 AND ((k.mask >> j::INT) & 1) = 1), 0) AS value FROM (SELECT DISTINCT game_id FROM eff) g, range(32) k(mask))"""


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE, {digits}) + 0.0 AS {name}"


FACT = "factorial({0}::INT)::DOUBLE"
fact = FACT.format
MARGIN = """d AS (SELECT a.game_id, a.n_items AS n, t.item::INT AS item_idx, bit_count(a.mask)::INT AS s, b.value - a.value AS delta FROM u a, range(62) t(item), u b
  WHERE t.item < a.n_items AND ((a.mask >> t.item::INT) & 1) = 0 AND b.game_id = a.game_id AND b.mask = a.mask | (1::BIGINT << t.item::INT))"""
SHAPLEY = f"{MARGIN}, shap AS (SELECT game_id, item_idx, sum(delta * {fact('s')} * {fact('(n - s - 1)')} / {fact('n')}) AS phi FROM d GROUP BY game_id, item_idx)"
BANZHAF = f"{MARGIN}, banz AS (SELECT game_id, item_idx, avg(delta) AS phi FROM d GROUP BY game_id, item_idx)"
LOO = f"{MARGIN}, out AS (SELECT game_id, item_idx, delta AS phi FROM d WHERE s = n - 1)"
SECOND = """q AS (SELECT a.game_id, a.n_items AS n, x.i::INT AS i, y.j::INT AS j, bit_count(a.mask)::INT AS s, d.value - b.value - c.value + a.value AS delta FROM u a, range(62) x(i), range(62) y(j), u b, u c, u d
  WHERE x.i < y.j AND y.j < a.n_items AND ((a.mask >> x.i::INT) & 1) = 0 AND ((a.mask >> y.j::INT) & 1) = 0 AND b.game_id = a.game_id AND c.game_id = a.game_id AND d.game_id = a.game_id
  AND b.mask = a.mask | (1::BIGINT << x.i::INT) AND c.mask = a.mask | (1::BIGINT << y.j::INT) AND d.mask = a.mask | (1::BIGINT << x.i::INT) | (1::BIGINT << y.j::INT))"""
SII = f"{SECOND}, sii AS (SELECT game_id, i, j, sum(delta * {fact('s')} * {fact('(n - s - 2)')} / {fact('(n - 1)')}) AS value FROM q GROUP BY game_id, i, j)"
BII = "bii AS (SELECT game_id, i, j, avg(delta) AS value FROM q GROUP BY game_id, i, j)"
MOBIUS = "mob AS (SELECT t.game_id, t.mask AS subset, bit_count(t.mask)::INT AS s, sum(v.value * (CASE WHEN bit_count(xor(t.mask, v.mask)) % 2 = 0 THEN 1 ELSE -1 END)) AS coef FROM u t JOIN u v ON t.game_id = v.game_id AND (v.mask & t.mask) = v.mask GROUP BY t.game_id, t.mask)"
FAITHFUL = """SELECT t.game_id, t.subset, round((t.coef + coalesce(sum(CASE t.s WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END * v.coef), 0))::DOUBLE, 6) + 0.0 AS coef
FROM mob t LEFT JOIN mob v ON v.game_id = t.game_id AND v.s > 2 AND (v.subset & t.subset) = t.subset WHERE t.s <= 2 GROUP BY t.game_id, t.subset, t.s, t.coef"""


def draw(*key: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(key)})), 1, 8))::BIGINT"


def unit(*key: str) -> str:
    return f"(({draw(*key)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


SIZES = "s AS (SELECT conv_id::BIGINT AS game_id, count(*)::INT AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1)"
KERNEL_SIZES = "sizes AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey UNION SELECT count(*) FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id), k AS (SELECT n::INT AS n, unnest(range(n + 1))::INT AS z FROM sizes)"
POWER = f"{SIZES}, c AS (SELECT game_id, n, unnest(range(1 << n)) AS mask FROM s), z AS (SELECT *, bit_count(mask)::INT AS z, (1 << n) - 1 AS top_mask FROM c)"
INNER = "z > 0 AND z < n"
LAW = "((n - 1)::DOUBLE / (z * (n - z)))"
COUNT = "(factorial(n)::DOUBLE / (factorial(z)::DOUBLE * factorial(n - z)::DOUBLE))"
SINGLE = "CASE WHEN z = 1 THEN 2 * round(log2(mask))::INT WHEN z = n - 1 THEN 2 * round(log2(top_mask - mask))::INT + 1 END"


def weighted(weight: str, source: str = "z", seed: str = "'42'") -> str:
    return f"CASE WHEN {weight} > 0 THEN -ln({unit(seed, 'game_id', 'mask')}) / {weight} END"


def sampled(budget: int, rank: str, weight: str | None) -> str:
    key = weighted(weight) if weight else "NULL"
    return f"""WITH {POWER}, k AS (SELECT *, {rank} AS rank FROM z), o AS (SELECT game_id, mask, rank, CASE WHEN rank IS NULL THEN {key} END AS key FROM k)
SELECT game_id, mask, row_number() OVER (PARTITION BY game_id ORDER BY rank NULLS LAST, key, mask) AS ord FROM o WHERE rank IS NOT NULL OR key IS NOT NULL QUALIFY ord <= {budget}"""


ENDS = "CASE WHEN mask = 0 THEN 0 WHEN mask = top_mask THEN 1 END"
NEAR = f"CASE WHEN mask = 0 THEN 0 WHEN mask = top_mask THEN 1 ELSE ({SINGLE}) + 2 END"
UNIFORM, SHAP_LAW, EVEN = "1.0::DOUBLE", f"(CASE WHEN {INNER} THEN {LAW} / {COUNT} ELSE 0.0 END)", f"(CASE WHEN {INNER} THEN 1.0::DOUBLE / {COUNT} ELSE 0.0 END)"
ITEM_LIST = "list_filter(range(n), lambda i: ((CASE WHEN z <= n - z THEN mask ELSE top_mask - mask END >> i::INT) & 1) = 1)"
BREADTH = f"""WITH {POWER} SELECT game_id, mask, row_number() OVER (PARTITION BY game_id ORDER BY least(z, n - z), CASE WHEN mask = 0 THEN 0 WHEN mask = top_mask THEN 1 ELSE (z > n - z)::INT END, {ITEM_LIST}) AS ord FROM z QUALIFY ord <= 40"""


def pool(weight: str) -> str:
    return f"WITH {G4}, z AS (SELECT game_id, mask, n_items AS n, bit_count(mask)::INT AS z FROM u), o AS (SELECT game_id, mask, {weighted(weight)} AS key FROM z) SELECT game_id, mask, row_number() OVER (PARTITION BY game_id ORDER BY key, mask) AS ord FROM o WHERE key IS NOT NULL QUALIFY ord <= 16"


PAIRED = f"""WITH {SIZES}, t AS (SELECT game_id, n, unnest(range(1, 31)) AS draw FROM s),
a AS (SELECT *, {draw("'42:item'", 'game_id', 'draw')} % n AS item, {unit("'42:size'", 'game_id', 'draw')} AS p FROM t),
law AS (SELECT n, z, (n - 1)::DOUBLE / (z * (n - z)) AS w FROM (SELECT DISTINCT n, unnest(range(1, n)) AS z FROM s)),
cum AS (SELECT n, z, sum(w) OVER (PARTITION BY n ORDER BY z) - w AS below, sum(w) OVER (PARTITION BY n) AS total FROM law),
b AS (SELECT game_id, a.n, draw, item, count(*) FILTER (WHERE below < p * total) AS z FROM a JOIN cum ON a.n = cum.n GROUP BY ALL),
m AS (SELECT game_id, draw, item, z, i, row_number() OVER (PARTITION BY game_id, draw ORDER BY {draw("'42:member'", 'game_id', 'draw', 'i')}, i) AS pos FROM (SELECT *, unnest(range(n)) AS i FROM b) WHERE i <> item)
SELECT game_id, draw, item AS item_idx, bit_or(CASE WHEN pos <= z THEN 1 << i::INT ELSE 0 END) AS mask_without, bit_or(CASE WHEN pos <= z THEN 1 << i::INT ELSE 0 END) | (1 << item::INT) AS mask_with FROM m GROUP BY game_id, draw, item"""
FLIP = f"""WITH b AS ({sampled(10, ENDS, UNIFORM)}), {SIZES}, n AS (SELECT game_id, mask, n FROM b JOIN s USING (game_id))
SELECT game_id, mask FROM n UNION SELECT game_id, xor(mask, 1::BIGINT << ({draw("'42:flip'", 'game_id', 'mask')} % n)::INT) FROM n"""
ORDER = f"""perm AS (SELECT game_id, n, iteration, item, row_number() OVER (PARTITION BY game_id, iteration ORDER BY {draw("'42:order'", 'game_id', 'iteration', 'item')}, item) - 1 AS position FROM (SELECT *, unnest(range(n)) AS item FROM (SELECT game_id, n, unnest(range(1, 21)) AS iteration FROM s))),
steps AS (SELECT *, coalesce(bit_or(1::BIGINT << item::INT) OVER (PARTITION BY game_id, iteration ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM perm)"""
DAYS = "s AS (SELECT DISTINCT game_id, n_items AS n FROM u)"
WALK = f"WITH {G4}, {DAYS}, {ORDER}, mar AS (SELECT st.game_id, n, item, position, b.value - a.value AS delta FROM steps st JOIN u a ON a.game_id = st.game_id AND a.mask = before JOIN u b ON b.game_id = st.game_id AND b.mask = before | (1::BIGINT << item::INT))"
KERNELS = f"""WITH {KERNEL_SIZES}
SELECT n, z, {r(f"CASE WHEN {INNER} THEN {LAW} / {COUNT} ELSE 0 END", "shap")}, {r(f"CASE WHEN {INNER} THEN {LAW} / {COUNT} ELSE 1000 END", "ends")},
{r("CASE WHEN z <= n - 1 THEN factorial(n - 1)::DOUBLE / (factorial(z)::DOUBLE * factorial(greatest(n - 1 - z, 0))::DOUBLE) ELSE 0 END", "sized")},
{r("CASE WHEN z < n THEN factorial(z)::DOUBLE * factorial(greatest(n - z - 1, 0))::DOUBLE / factorial(n)::DOUBLE END", "shapley")},
{r("CASE WHEN z <= n - 2 THEN factorial(z)::DOUBLE * factorial(greatest(n - z - 2, 0))::DOUBLE / factorial(n - 1)::DOUBLE END", "pair")},
{r("CASE WHEN z < n THEN 16 * pow(CASE WHEN n > 1 THEN z::DOUBLE / (n - 1) ELSE 0.5 END, 15) END", "beta")} FROM k"""
HAMMING = f"""WITH {G4}, z AS (SELECT game_id, 5 AS n, mask, bit_count(mask)::INT AS z, 31 AS top_mask FROM u), k AS (SELECT *, {ENDS} AS rank FROM z),
o AS (SELECT game_id, mask, rank, CASE WHEN rank IS NULL THEN {weighted(SHAP_LAW)} END AS key FROM k), c AS (SELECT game_id, mask FROM o WHERE rank IS NOT NULL OR key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY rank NULLS LAST, key, mask) <= 16)
SELECT a.game_id, round(log2(b.mask - a.mask))::INT AS item_idx, a.mask AS mask_without, b.mask AS mask_with FROM c a JOIN c b ON a.game_id = b.game_id AND a.mask < b.mask AND bit_count(xor(a.mask, b.mask)) = 1"""

ITEMS = f"WITH {G4}, {SHAPLEY}, sc AS (SELECT game_id, item_idx, round(d.delta, 9) AS pred, round(phi, 9) AS truth FROM shap JOIN d USING (game_id, item_idx) WHERE d.s = d.n - 1)"
COALITIONS = f"WITH {G4}, {LOO}, sc AS (SELECT u.game_id, n_items, mask, round(coalesce(sum(phi) FILTER (WHERE ((mask >> item_idx) & 1) = 1), 0), 9) AS pred, round(any_value(value), 9) AS truth FROM u JOIN out USING (game_id) GROUP BY u.game_id, n_items, mask)"


def pair_scores(f: str = "") -> str:
    return f"WITH {G4}, {SII}, {BII}, sc AS (SELECT game_id, i * 64 + j AS item_idx, {f}(round(bii.value, 9)) AS pred, {f}(round(sii.value, 9)) AS truth FROM sii JOIN bii USING (game_id, i, j))"


def rank(c: str) -> str:
    return f"rank() OVER (PARTITION BY game_id ORDER BY {c}) + (count(*) OVER (PARTITION BY game_id, {c}) - 1) / 2.0::DOUBLE"


def corr(x: str, y: str, source: str) -> str:
    return f"SELECT game_id, CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN round(corr({x}, {y}), 6) + 0.0 END AS value FROM {source} GROUP BY game_id"


R2 = "SELECT game_id, " + "CASE WHEN sum(d) > 0 THEN round(1 - sum(e) / sum(d), 6) + 0.0 END AS value FROM (SELECT game_id, (truth - pred) * (truth - pred) AS e, pow(truth - avg(truth) OVER (PARTITION BY game_id), 2) AS d FROM {0}) GROUP BY game_id"
KENDALL = "SELECT a.game_id, CASE WHEN sum(abs(sign(a.pred - b.pred))) > 0 AND sum(abs(sign(a.truth - b.truth))) > 0 THEN round(sum(sign(a.pred - b.pred) * sign(a.truth - b.truth)) / sqrt(sum(abs(sign(a.pred - b.pred)))::DOUBLE * sum(abs(sign(a.truth - b.truth)))), 6) + 0.0 END AS value FROM sc a JOIN sc b ON a.game_id = b.game_id AND a.item_idx < b.item_idx GROUP BY a.game_id"


def ndcg(k: int, gain: str) -> str:
    return f"""g AS (SELECT game_id, pred, {gain} AS gain FROM sc), o AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY pred DESC) AS r, row_number() OVER (PARTITION BY game_id ORDER BY gain DESC) AS b FROM g),
t AS (SELECT game_id, pred, avg(gain) AS gain, sum(CASE WHEN r <= {k} THEN 1 / log2(r + 1) ELSE 0 END) AS disc FROM o GROUP BY game_id, pred), dcg AS (SELECT game_id, sum(gain * disc) AS dcg FROM t GROUP BY game_id),
best AS (SELECT game_id, sum(CASE WHEN b <= {k} THEN gain / log2(b + 1) ELSE 0 END) AS ideal FROM o GROUP BY game_id)
SELECT game_id, CASE WHEN ideal > 0 THEN round(dcg / ideal, 6) + 0.0 END AS value FROM dcg JOIN best USING (game_id)"""


UNIT_VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings)"


def near(k: int) -> str:
    return f"""WITH {UNIT_VEC}, n AS (SELECT q.vec_id AS query_id, v.vec_id, v.label = q.label AS same, list_sum(list_transform(list_zip(v.e, q.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM v, v q WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) - 1 AS item_idx, dist, -dist AS pred, same::INT AS truth FROM n QUALIFY item_idx < {k})"""


PAIRS = f"WITH {G4}, {SII}, p AS (SELECT game_id, i, j, round(value, 9) AS value FROM sii), o AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY value DESC, i, j) AS place FROM p)"
TOP2 = f"WITH {G4}, {SHAPLEY}, t AS (SELECT game_id, bit_or(1::BIGINT << item_idx) AS top FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY round(phi, 9) DESC, item_idx) AS place FROM shap) WHERE place <= 2 GROUP BY game_id)"
LINEAR = f"{BANZHAF}, co AS (SELECT game_id, avg(value) AS mean FROM u GROUP BY game_id), icpt AS (SELECT co.game_id, mean - sum(phi) / 2 AS b0 FROM co JOIN banz ON banz.game_id = co.game_id GROUP BY co.game_id, mean)"
BEFORE = "b AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"
METRIC = "mr AS (SELECT o_custkey AS qid, o_orderpriority AS method, year(o_orderdate) AS budget, max(o_totalprice) AS value, 'price' AS metric FROM orders GROUP BY 1, 2, 3)"
AGAINST = f"{METRIC}, pr AS (SELECT r.metric, r.budget, r.method, r.qid, b.value AS x, r.value AS y, b.value - r.value AS d FROM mr r JOIN mr b ON b.metric = r.metric AND b.budget = r.budget AND b.qid = r.qid WHERE b.method = '1-URGENT' AND r.method <> '1-URGENT')"
TRUE_COEF = "SELECT game_id, 0::BIGINT AS subset, 0.0::DOUBLE AS coef FROM (SELECT DISTINCT game_id FROM eff) UNION ALL SELECT game_id, 1::BIGINT << item::INT, w FROM eff UNION ALL SELECT game_id, (1::BIGINT << i::INT) | (1::BIGINT << j::INT), value FROM prs"
CUT = "string_split(regexp_replace(coalesce(text, ''), '([.!?])[\\x20\\x09-\\x0D]+', '\\1' || chr(1), 'g'), chr(1))"
LOG_PROBS = f"""{G2}, kinds AS (SELECT game_id, count(*) + 1 AS kinds FROM gold GROUP BY game_id),
lp AS (SELECT l.game_id, l.mask, sum(g * ln((coalesce(c, 0) + 1)::DOUBLE / (ls + kinds))) AS lp, sum(g * ln(1.0::DOUBLE / kinds)) AS lp0 FROM lens l JOIN gold ON gold.game_id = l.game_id JOIN kinds ON kinds.game_id = l.game_id LEFT JOIN cnt ON cnt.game_id = l.game_id AND cnt.mask = l.mask AND cnt.w = gold.w GROUP BY ALL),
c AS (SELECT masks.game_id, masks.mask, gs, coalesce(lp, 0) AS lp, coalesce(lp0, 0) AS lp0 FROM masks LEFT JOIN lp USING (game_id, mask))"""
LP, LP0, L = "lp", "lp0", "gs"


AGREE = f"""WITH {G4}, {SHAPLEY}, {BANZHAF.removeprefix(MARGIN + ', ')}, {LOO.removeprefix(MARGIN + ', ')}, attr AS (SELECT 'banzhaf' AS provider, game_id, item_idx, round(phi, 9) AS phi FROM banz UNION ALL SELECT 'loo', game_id, item_idx, round(phi, 9) FROM out UNION ALL SELECT 'shapley', game_id, item_idx, round(phi, 9) FROM shap),
sc AS (SELECT l.provider AS a, r.provider AS b, l.game_id, l.item_idx, l.phi AS pred, r.phi AS truth FROM attr l JOIN attr r ON l.game_id = r.game_id AND l.item_idx = r.item_idx AND l.provider < r.provider),
rk AS (SELECT a, b, game_id, rank() OVER (PARTITION BY a, b, game_id ORDER BY pred) + (count(*) OVER (PARTITION BY a, b, game_id, pred) - 1) / 2.0::DOUBLE AS p, rank() OVER (PARTITION BY a, b, game_id ORDER BY truth) + (count(*) OVER (PARTITION BY a, b, game_id, truth) - 1) / 2.0::DOUBLE AS t FROM sc),
sp AS (SELECT a, b, game_id, CASE WHEN stddev_pop(p) > 0 AND stddev_pop(t) > 0 THEN corr(p, t) END AS v FROM rk GROUP BY ALL),
kd AS (SELECT x.a, x.b, x.game_id, CASE WHEN sum(abs(sign(x.pred - y.pred))) > 0 AND sum(abs(sign(x.truth - y.truth))) > 0 THEN sum(sign(x.pred - y.pred) * sign(x.truth - y.truth)) / sqrt(sum(abs(sign(x.pred - y.pred)))::DOUBLE * sum(abs(sign(x.truth - y.truth)))) END AS v FROM sc x JOIN sc y ON x.a = y.a AND x.b = y.b AND x.game_id = y.game_id AND x.item_idx < y.item_idx GROUP BY ALL),
ov AS (SELECT a, b, game_id, count(*) FILTER (WHERE one <= 2 AND two <= 2) / 2.0 AS v FROM (SELECT *, row_number() OVER (PARTITION BY a, b, game_id ORDER BY abs(pred) DESC, item_idx) AS one, row_number() OVER (PARTITION BY a, b, game_id ORDER BY abs(truth) DESC, item_idx) AS two FROM sc) GROUP BY ALL)
SELECT a AS "left", b AS "right", {r('avg(sp.v)', 'spearman')}, {r('avg(kd.v)', 'kendall')}, {r('avg(ov.v)', 'overlap')} FROM sp JOIN kd USING (a, b, game_id) JOIN ov USING (a, b, game_id) GROUP BY 1, 2"""
#: The error function by its series of positive terms.
ERF = "CASE WHEN x = 0 THEN 0 ELSE 2 * x / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(150), lambda k: exp(k * ln(2 * x * x) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2))) END"
RANKED = f"{AGAINST}, k AS (SELECT *, CASE WHEN d <> 0 THEN rank() OVER (PARTITION BY metric, budget, method, d <> 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, budget, method, d <> 0, abs(d)) - 1) / 2.0::DOUBLE END AS r FROM pr), t AS (SELECT metric, budget, method, count(*) AS n, count(r) AS nonzero, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS rp, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS rn, avg((d > 0)::INT) AS w FROM k GROUP BY 1, 2, 3)"
RANK_COLUMNS = f"metric, budget, method, n, nonzero, {r('CASE WHEN nonzero >= 6 THEN rp END', 'r_pos')}, {r('CASE WHEN nonzero >= 6 THEN rn END', 'r_neg')}, {r('CASE WHEN nonzero >= 6 THEN (rp - rn) / (rp + rn) END', 'effect')}, {r('w', 'win_rate')}"
WILCOXON = f"""WITH RECURSIVE {RANKED}, ways(m, c) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT m + 1, list_transform(range(len(c) + m + 1), lambda s: coalesce(CASE WHEN s < len(c) THEN c[s + 1] END, 0) + coalesce(CASE WHEN s >= m + 1 THEN c[s - m] END, 0)) FROM ways WHERE m < 50),
tie AS (SELECT metric, budget, method, sum(t * t * t - t) AS tied FROM (SELECT metric, budget, method, abs(d), count(*)::DOUBLE AS t FROM pr WHERE d <> 0 GROUP BY ALL) GROUP BY 1, 2, 3),
z AS (SELECT t.*, coalesce(tied, 0) AS tied, least(rp, rn) AS low, CASE WHEN nonzero >= 6 THEN abs(least(rp, rn) - nonzero * (nonzero + 1) / 4) / sqrt(nonzero * (nonzero + 1) * (2 * nonzero + 1) / 24 - coalesce(tied, 0) / 48) / sqrt(2) END AS x FROM t LEFT JOIN tie USING (metric, budget, method))
SELECT {RANK_COLUMNS}, {r(f"CASE WHEN nonzero < 6 THEN NULL WHEN nonzero <= 50 AND tied = 0 THEN least(1, 2 * list_sum(c[1:low::INT + 1]) / pow(2, nonzero)) ELSE 1 - ({ERF}) END", 'p')} FROM z LEFT JOIN ways ON m = least(nonzero, 50)"""


def logit(lp: str) -> str:
    p = f"greatest(least(exp({lp}), 1 - 1e-7::DOUBLE), 1e-7::DOUBLE)"
    return f"ln({p} / (1 - {p}))"


def mode(expr: str, name: str) -> str:
    return r(f"CASE WHEN {L} > 0 THEN {expr} ELSE 0 END", name)


ORACLE: dict[str, str] = {
    **{f"g{k}_utilities": f"WITH {g} SELECT game_id, n_items, mask, {r('value', 'value')} FROM u" for k, g in ((1, G1), (2, G2), (3, G3), (4, G4))},
    "g5_retrieval": f"{near(10)} SELECT query_id, vec_id, item_idx, {r('pred', 'pred')}, truth FROM r",
    "exact_shapley": f"WITH {G1}, {SHAPLEY} SELECT game_id, item_idx, {r('phi', 'phi')} FROM shap",
    "shapley_conversations": f"WITH {G2}, {SHAPLEY} SELECT game_id, item_idx, {r('phi', 'phi')} FROM shap",
    "exact_banzhaf": f"WITH {G4}, {BANZHAF} SELECT game_id, item_idx, {r('phi', 'phi')} FROM banz",
    "sii_pairs": f"WITH {G4}, {SII} SELECT game_id, i, j, {r('value', 'value')} FROM sii",
    "banzhaf_pairs": f"WITH {G4}, {SECOND}, {BII} SELECT game_id, i, j, {r('value', 'value')} FROM bii",
    "mobius": f"WITH {G4}, {MOBIUS} SELECT game_id, subset, {r('coef', 'coef')} FROM mob",
    "fsii_order2": f"WITH {G1}, {MOBIUS} " + FAITHFUL.format("0", "-2.0/3 * ((v.s - 1) * (v.s - 2) / 2.0) / ((v.s + 1) * v.s * (v.s - 1) / 6.0)", "0.5 * ((v.s - 1) * (v.s - 2) / 2.0) / ((v.s + 1) * v.s * (v.s - 1) * (v.s - 2) / 24.0)"),
    "fbii_order2": f"WITH {G4}, {MOBIUS} " + FAITHFUL.format("pow(2.0, -v.s) * (v.s - 1) * (v.s - 2) / 2.0", "-pow(2.0, 1 - v.s) * (v.s - 2)", "pow(2.0, 2 - v.s)"),
    "loo": f"WITH {G4}, {LOO} SELECT game_id, item_idx, {r('phi', 'phi')} FROM out",
    "topk_exhaustive_removal": f"WITH {G4} SELECT game_id, 31 - mask AS removed, {r('value', 'value')} FROM u WHERE bit_count(mask) = 3 QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY value, mask DESC) = 1",
    "jsd": f"""WITH c AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE) AS game_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), a AS (SELECT event_type, sum(n) AS al FROM c GROUP BY 1),
g AS (SELECT d.game_id, a.event_type, coalesce(n, 0) AS n, al FROM (SELECT DISTINCT game_id FROM c) d CROSS JOIN a LEFT JOIN c ON c.game_id = d.game_id AND c.event_type = a.event_type),
h AS (SELECT game_id, n / sum(n) OVER w + 1e-10 AS p, al / sum(al) OVER w + 1e-10 AS q FROM g WINDOW w AS (PARTITION BY game_id)), k AS (SELECT game_id, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM h WINDOW w AS (PARTITION BY game_id)),
j AS (SELECT game_id, sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2 AS jsd FROM k GROUP BY game_id) SELECT game_id, {r('jsd', 'jsd')}, {r('exp(-jsd)', 'utility')} FROM j""",
    "powerset": f"WITH {POWER} SELECT game_id, mask FROM c",
    "sample_uniform": sampled(40, ENDS, UNIFORM),
    "sample_kernelshap": sampled(40, ENDS, SHAP_LAW),
    "sample_bf": BREADTH,
    "sample_bf_uniform": sampled(40, NEAR, UNIFORM),
    "sample_bf_kernelshap": sampled(40, NEAR, SHAP_LAW),
    "structured_sample": sampled(40, SINGLE, EVEN),
    "structured_truncated": sampled(9, NEAR, None),
    "pool_uniform": pool(UNIFORM),
    "pool_kernel_weighted": pool(f"(CASE WHEN {INNER} THEN {LAW} ELSE 0.0 END)"),
    "paired_coalitions": PAIRED,
    "flip_expand": FLIP,
    "random_permutations": f"WITH {SIZES}, {ORDER} SELECT game_id, iteration, position, item AS item_idx, before AS mask_before FROM steps",
    "kernel_weights": KERNELS,
    "hamming1_pairs": HAMMING,
    "beta_shapley": f"{WALK}, w AS (SELECT game_id, item, delta, 4 * pow(position::DOUBLE / (n - 1), 3) AS w FROM mar) SELECT game_id, item AS item_idx, {r('CASE WHEN sum(w) > 1e-9 THEN sum(w * delta) / sum(w) ELSE 0 END', 'phi')} FROM w GROUP BY game_id, item",
    "tmc_untruncated": f"{WALK} SELECT game_id, item AS item_idx, {r('avg(delta)', 'phi')} FROM mar GROUP BY game_id, item",
    "pearson": f"{ITEMS} {corr('pred', 'truth', 'sc')}",
    "lds_spearman": f"{COALITIONS}, rk AS (SELECT game_id, {rank('pred')} AS p, {rank('truth')} AS t FROM sc) {corr('p', 't', 'rk')}",
    "kendall_tau_b": f"{ITEMS} {KENDALL}",
    "r2_util": f"{COALITIONS} {R2.format('sc')}",
    "delta_r2": f"{COALITIONS}, dl AS (SELECT a.game_id, b.pred - a.pred AS pred, b.truth - a.truth AS truth FROM sc a JOIN sc b ON a.game_id = b.game_id AND a.mask < b.mask AND bit_count(xor(a.mask, b.mask)) = 1) {R2.format('dl')}",
    "ndcg_at_k": f"{ITEMS}, {ndcg(3, 'truth - min(truth) OVER (PARTITION BY game_id)')}",
    "ndcg_inter_at_k": f"{pair_scores('abs')}, {ndcg(5, 'truth')}",
    "average_precision": f"{near(10)}, t AS (SELECT query_id, pred, sum(truth) AS hits, count(*) AS n FROM r GROUP BY 1, 2), c AS (SELECT query_id, hits, n, sum(hits) OVER w / sum(n) OVER w AS prec FROM t WINDOW w AS (PARTITION BY query_id ORDER BY pred DESC)) SELECT query_id, CASE WHEN sum(hits) > 0 AND sum(hits) < sum(n) THEN round(sum(hits * prec) / sum(hits), 6) + 0.0 END AS value FROM c GROUP BY query_id",
    "recall_at_k": f"{near(10)} SELECT query_id, CASE WHEN sum(truth) > 0 THEN round(coalesce(sum(truth) FILTER (WHERE item_idx < 3), 0) / sum(truth), 6) + 0.0 END AS value FROM r GROUP BY query_id",
    "precision_at_gt": f"{near(10)}, g AS (SELECT query_id, item_idx, truth, sum(truth) OVER (PARTITION BY query_id) AS gold FROM r) SELECT query_id, CASE WHEN max(gold) > 0 THEN round(coalesce(sum(truth) FILTER (WHERE item_idx < gold), 0) / max(gold), 6) + 0.0 END AS value FROM g GROUP BY query_id",
    "topk_drop": f"{TOP2} SELECT t.game_id, {r('a.value - b.value', 'value')} FROM t JOIN u a ON a.game_id = t.game_id AND a.mask = 31 JOIN u b ON b.game_id = t.game_id AND b.mask = 31 - top",
    "topk_only_utility": f"{TOP2} SELECT t.game_id, {r('value', 'value')} FROM t JOIN u ON u.game_id = t.game_id AND u.mask = top",
    "rr_at_k": f"{PAIRS} SELECT game_id, {r('sum((i < 3)::INT + (j < 3)::INT) / 6.0', 'value')} FROM o WHERE place <= 3 GROUP BY game_id",
    "pair_recall_at_k": f"{PAIRS} SELECT game_id, {r('count(*) FILTER (WHERE j < 3 AND place <= 3) / 3.0', 'value')} FROM o GROUP BY game_id",
    "extreme_pair": f"{PAIRS}, lo AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY value, i, j) AS least FROM o) SELECT 'max' AS side, count(*) AS n, {r('avg((i = 0 AND j = 1)::INT)', 'value')} FROM lo WHERE place = 1 UNION ALL SELECT 'min', count(*), {r('avg((i = 0 AND j = 1)::INT)', 'value')} FROM lo WHERE least = 1",
    "topk_overlap": f"{ITEMS}, o AS (SELECT game_id, row_number() OVER (PARTITION BY game_id ORDER BY abs(pred) DESC, item_idx) <= 2 AND row_number() OVER (PARTITION BY game_id ORDER BY abs(truth) DESC, item_idx) <= 2 AS shared_top FROM sc) SELECT game_id, {r('count(*) FILTER (WHERE shared_top) / 2.0', 'value')} FROM o GROUP BY game_id",
    "sign_agreement": f"{pair_scores()}, m AS (SELECT *, max(abs(pred)) OVER w AS mp, max(abs(truth)) OVER w AS mt FROM sc WINDOW w AS (PARTITION BY game_id)), s AS (SELECT game_id, mp > 0 AND mt > 0 AND abs(pred) >= 0.1::DOUBLE * mp AND abs(truth) >= 0.1::DOUBLE * mt AS strong, sign(pred) = sign(truth) AS same FROM m) SELECT game_id, count(*) FILTER (WHERE strong) AS n_strong, {r('avg(same::INT) FILTER (WHERE strong)', 'sign_agree')}, {r('1 - count(*) FILTER (WHERE strong) / count(*)', 'weak_frac')} FROM s GROUP BY game_id",
    "correctness_split": f"{PAIRS}, m AS (SELECT *, max(abs(value)) OVER (PARTITION BY game_id) AS top FROM p) SELECT game_id % 2 = 0 AS correct, count(*) AS n_strong, {r('avg((value > 0)::INT)', 'positive')} FROM m WHERE value <> 0 AND abs(value) >= 0.1::DOUBLE * top GROUP BY 1",
    "minmax_mean_matrix": f"{PAIRS}, m AS (SELECT i, j, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM p WINDOW w AS (PARTITION BY game_id)) SELECT i, j, {r('avg(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END)', 'value')} FROM m GROUP BY i, j",
    "linear_fit": f"WITH {G4}, {LINEAR} SELECT game_id, 0::BIGINT AS subset, {r('b0', 'coef')} FROM icpt UNION ALL SELECT game_id, 1::BIGINT << item_idx, {r('phi', 'coef')} FROM banz",
    "poly2_fit": f"WITH {G3}, k AS ({TRUE_COEF}) SELECT game_id, subset, {r('coef', 'coef')} FROM k",
    "fm_attributions": f"WITH {G3} SELECT game_id, item AS item_idx, {r('w + (SELECT sum(value) FROM prs WHERE prs.game_id = eff.game_id AND (i = item OR j = item)) / 2', 'phi')} FROM eff",
    "hybrid_wss": f"WITH {G4.replace('u AS (', 'u0 AS (')}, u1 AS (SELECT * FROM u0), {LINEAR.replace('FROM u ', 'FROM u1 ').replace('u a,', 'u1 a,').replace('u b', 'u1 b')}, u AS (SELECT u1.game_id, n_items, mask, CASE WHEN bit_count(mask) % 2 = 0 THEN any_value(value) ELSE any_value(b0) + coalesce(sum(phi) FILTER (WHERE ((mask >> item_idx) & 1) = 1), 0) END AS value FROM u1 JOIN icpt USING (game_id) JOIN banz USING (game_id) GROUP BY u1.game_id, n_items, mask), {SHAPLEY.replace('d AS', 'd2 AS').replace('FROM d ', 'FROM d2 ')} SELECT game_id, item_idx, {r('phi', 'phi')} FROM shap",
    "prune_topq": f"{PAIRS} SELECT game_id, i, j, {r('value', 'value')}, rank() OVER (PARTITION BY game_id ORDER BY abs(value) DESC) <= 3 AS kept FROM p",
    "prune_mad": f"{PAIRS}, m AS (SELECT game_id, median(abs(value)) AS med FROM p GROUP BY 1), a AS (SELECT p.game_id, med, median(abs(abs(value) - med)) AS mad FROM p JOIN m USING (game_id) GROUP BY 1, 2) SELECT game_id, i, j, {r('value', 'value')}, abs(value) >= med + 1.4826::DOUBLE * mad AS kept FROM p JOIN a USING (game_id)",
    "normalise_answer": f"SELECT conv_id, turn, array_to_string({tokens('text')}, ' ') AS normal FROM conversations",
    "exact_match": f"WITH {BEFORE} SELECT conv_id, turn, (array_to_string({tokens('text')}, ' ') = array_to_string({tokens('before')}, ' '))::INT AS em FROM b",
    "token_f1": f"""WITH {BEFORE}, t AS (SELECT conv_id, turn, {tokens('text')} AS x, {tokens('before')} AS y FROM b), cx AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(x) AS w FROM t) GROUP BY ALL), cy AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(y) AS w FROM t) GROUP BY ALL),
s AS (SELECT cx.conv_id, cx.turn, sum(least(cx.c, cy.c)) AS shared FROM cx JOIN cy USING (conv_id, turn, w) GROUP BY ALL) SELECT conv_id, turn, {r(f1('coalesce(shared, 0)', 'len(x)', 'len(y)'), 'f1')} FROM t LEFT JOIN s USING (conv_id, turn)""",
    "clean_text": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g'), '[^\p{L}\p{N}\x20.,;:!?''()%/-]', '', 'g'), ' +', ' ', 'g'))) AS cleaned FROM documents",
    "sentence_items": f"WITH c AS (SELECT row_number() OVER () AS rid, item_id, list_filter(list_transform({CUT}, lambda x: trim(x)), lambda x: x <> '') AS s FROM benchmark) SELECT item_id, unnest(range(len(s))) AS sentence_idx, unnest(s) AS sentence FROM c",
    "ablated_context": f"WITH {TURNS} SELECT game_id, array_to_string(list(text ORDER BY item) FILTER (WHERE item IN (0, 2) AND item < size - 1), chr(10) || chr(10)) AS context, (1::BIGINT << (max(size) - 1)::INT) - 2 AS mask FROM held GROUP BY game_id",
    "gold_first_reorder": "WITH t AS (SELECT conv_id, coalesce(text, '') AS text, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'assistant' THEN 0 ELSE 1 END, turn) AS pos FROM conversations) SELECT conv_id, string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE pos <= 10) AS texts, count(*) FILTER (WHERE role = 'assistant') AS len_gt FROM t GROUP BY conv_id",
    "duplicate_injection": f"WITH {TURNS}, a AS (SELECT game_id, item * 2 AS pos, text, size - 1 AS n FROM held WHERE item < size - 1), b AS (SELECT * FROM a UNION ALL SELECT game_id, least(2 * n - 1, 9), text, n FROM a WHERE pos = 2) SELECT game_id, string_agg(text, chr(10) ORDER BY pos) AS texts FROM b GROUP BY game_id",
    "lookup_conflicts": "SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS lang, CASE count(DISTINCT lang) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'conflict' END AS status FROM documents GROUP BY source",
    "knn_l2": f"{near(5)} SELECT query_id, vec_id, item_idx, {r('dist', 'distance', 5)} FROM r",
    "normalised_vectors": f"SELECT vec_id, {r('list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))', 'squared', 5)}, {r('embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))', 'first', 5)} FROM embeddings",
    "utility_modes": f"WITH {LOG_PROBS} SELECT game_id, mask, {mode(f'{LP} - {LP0}', 'log_prob')}, {mode(f'exp({LP}) - exp({LP0})', 'raw_prob')}, {mode(f'{logit(LP)} - {logit(LP0)}', 'logit_prob')}, {mode(f'({LP} - {LP0}) / {L}', 'log_perplexity')}, {mode(f'({logit(LP)} - {logit(LP0)}) / {L}', 'logit_per_token')}, {mode(f'-exp(-{LP} / {L})', 'neg_perplexity')}, {mode(LP, 'logprob_raw')} FROM c",
    "method_budget_parse": r"WITH k AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority || '_' || (o_orderkey % 700) ELSE o_orderpriority END AS key FROM orders) SELECT key, CASE WHEN regexp_matches(key, '^.+_\d+$') THEN regexp_extract(key, '^(.+?)_(\d+)$', 1) ELSE key END AS method, CASE WHEN regexp_matches(key, '^.+_\d+$') THEN regexp_extract(key, '^(.+?)_(\d+)$', 2)::INT END AS budget FROM k",
    "long_metrics": f"SELECT c_custkey AS qid, 'balance' AS metric, {r('c_acctbal', 'value')} FROM customer UNION ALL SELECT c_custkey, 'root', {r('sqrt(c_acctbal)', 'value')} FROM customer WHERE c_acctbal > 0",
    "paired_align": f"WITH {METRIC} SELECT a.metric, a.budget, a.qid, {r('a.value', 'x')}, {r('b.value', 'y')} FROM mr a JOIN mr b USING (metric, budget, qid) WHERE a.method = '1-URGENT' AND b.method = '5-LOW'",
    "mean_nanstd": f"WITH {METRIC} SELECT metric, method, budget, count(*) AS n, {r('avg(value)', 'mean', 6)}, {r('stddev_pop(value)', 'sd', 6)} FROM mr GROUP BY 1, 2, 3",
    "variance_report": f"WITH {METRIC} SELECT metric, method, budget, count(*) AS n, {r('avg(value)', 'mean', 6)}, {r('stddev_samp(value)', 'sd', 6)}, {r('stddev_samp(value) / sqrt(count(*))', 'sem', 6)}, {r('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)', 'iqr', 6)} FROM mr GROUP BY 1, 2, 3",
    "win_tie_loss": f"WITH {AGAINST} SELECT metric, budget, method, count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d = 0) AS ties, count(*) FILTER (WHERE d < 0) AS losses, {r('CASE WHEN count(*) FILTER (WHERE d <> 0) > 0 THEN count(*) FILTER (WHERE d > 0) / count(*) FILTER (WHERE d <> 0) END', 'win_excl_ties', 6)}, {r('avg(d)', 'mean_diff', 6)}, {r('median(d)', 'median_diff', 6)} FROM pr GROUP BY 1, 2, 3",
    "signed_rank": f"WITH {RANKED} SELECT {RANK_COLUMNS} FROM t",
    "wilcoxon": WILCOXON,
    "agreement_matrix": AGREE,
    "holm": f"WITH t AS (SELECT n_nationkey, n_regionkey, (n_nationkey * 7 % 25 + 1) / 250.0::DOUBLE AS p FROM nation), s AS (SELECT *, (count(*) OVER (PARTITION BY n_regionkey) - row_number() OVER (PARTITION BY n_regionkey ORDER BY p) + 1) * p AS step FROM t) SELECT n_nationkey, n_regionkey, {r('p', 'p')}, {r('least(1, max(step) OVER (PARTITION BY n_regionkey ORDER BY p ROWS UNBOUNDED PRECEDING))', 'p_holm')} FROM s",
    "detectable_effect": f"SELECT event_type, count(value) AS n, {r('2.8015852181104035 * stddev_samp(value) / sqrt(count(value))', 'effect', 4)}, ceil(pow(2.8015852181104035 * stddev_samp(value) / 0.042::DOUBLE, 2))::BIGINT AS pairs FROM events GROUP BY event_type",
    "paired_correlation": f"WITH {AGAINST} SELECT metric, budget, method, CASE WHEN count(*) > 1 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 6) + 0.0 END AS value FROM pr GROUP BY 1, 2, 3",
    "budget_table": f"WITH {METRIC} SELECT metric, method, {r('avg(value) FILTER (WHERE budget = 1995)', 'y1995', 6)}, {r('avg(value) FILTER (WHERE budget = 1996)', 'y1996', 6)}, {r('avg(value) FILTER (WHERE budget = 1997)', 'y1997', 6)} FROM mr GROUP BY 1, 2",
    "minmax_scaled": f"{pair_scores()}, m AS (SELECT game_id, item_idx, pred, truth, least(min(pred) OVER w, min(truth) OVER w) AS lo, greatest(max(pred) OVER w, max(truth) OVER w) AS hi FROM sc WINDOW w AS (PARTITION BY game_id)) SELECT game_id, item_idx, {r('CASE WHEN hi > lo THEN (pred - lo) / (hi - lo) ELSE 0 END', 'pred')}, {r('CASE WHEN hi > lo THEN (truth - lo) / (hi - lo) ELSE 0 END', 'truth')} FROM m",
    "stream_coverage": f"WITH {G4} SELECT game_id, m, n FROM cover WHERE DATE '1970-01-01' + (game_id + 1)::INT <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY",
}
