"""Queries over sources, result tables, preparation, providers and wide games, each with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import bits, kernels, utilities
from tessera.operators import coalitions, exact, prepare, providers, stats, surrogates
from tessera.plans import ablation, games
from tessera.plans import oracles as o
from tessera.plans import queries as core
from tessera.plans.games import table
from tessera.sources import questions, tables
from tessera.sources.scratch import scratch_dir

QUERIES: dict[str, core.Query] = {}
ORACLE: dict[str, str] = {}
rounded, r = core.rounded, o.r


def query(sql: str | None = None, queries: dict[str, core.Query] = QUERIES, oracle: dict[str, str] = ORACLE) -> Callable[[core.Query], core.Query]:
    def add(f: core.Query) -> core.Query:
        queries[f.__name__] = f
        if sql:
            oracle[f.__name__] = sql
        return f

    return add


# Sources: tables written in each format and read by its reader

TALKS = "talks AS (SELECT conv_id, coalesce(text, '') AS text, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS item, count(*) OVER (PARTITION BY conv_id) AS size FROM conversations)"
PRINTED = f"WITH {TALKS} SELECT conv_id, md5(string_agg(text, '|' ORDER BY item)) AS context, count(*) AS n, md5(max(text) FILTER (WHERE item = 0)) AS question FROM talks GROUP BY conv_id"


def talks(spark, sf) -> DataFrame:
    """(conv_id, question, context, answer): a conversation's first turn, all of its turns, and its last one."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"), "role"))).alias("t"))
    texts = F.transform("t", lambda x: x["text"])
    return rows.select("conv_id", "t", F.element_at(texts, 1).alias("question"), texts.alias("context"), F.element_at(texts, -1).alias("answer"))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", F.md5(F.array_join("context", "|")).alias("context"), F.size("context").cast("bigint").alias("n"), F.md5("question").alias("question"))


def written_csv(spark, sf, sep: str) -> str:
    path = scratch_dir(spark, "csv")
    rows = talks(spark, sf).select("conv_id", "question", F.to_json("context").alias("context"))
    rows.write.options(header=True, sep=sep, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


@query(PRINTED)
def source_csv(spark, sf):
    return digest(questions.read_csv(spark, written_csv(spark, sf, ","), "conv_id bigint, question string, context string"))


@query(f"{PRINTED} ORDER BY conv_id LIMIT 5")
def source_csv_semicolon(spark, sf):
    """Another delimiter, and the first five rows alone, which is the feature."""
    return digest(questions.read_csv(spark, written_csv(spark, sf, ";"), "conv_id bigint, question string, context string", sep=";").orderBy("conv_id").limit(5))


@query("SELECT o_orderstatus AS status, count(*) AS n, max(o_orderkey) AS top, round(sum(o_totalprice)::DOUBLE, 2) AS total FROM orders GROUP BY 1")
def source_json_lines(spark, sf):
    path = scratch_dir(spark, "jsonl")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.json(path)
    rows = questions.read_json_lines(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double")
    return rows.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("top"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT n_regionkey::BIGINT AS game_id, n_name AS text, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1)::INT AS item_idx FROM nation")
def source_json_array(spark, sf):
    """Regions as questions with their nations as documents, from one file that is a JSON array."""
    path = scratch_dir(spark, "json")
    one = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("documents"))
    one.select(F.struct(F.col("n_regionkey").cast("bigint").alias("id"), F.lit("Which?").alias("question"), "documents").alias("q")).agg(F.to_json(F.collect_list("q")).alias("value")).coalesce(1).write.text(path)
    return questions.items_of(questions.as_questions(questions.read_json_array(spark, path), "regions", F.col("id"), "documents"))


@query("SELECT line FROM (SELECT n_name AS line FROM nation UNION ALL SELECT r_name FROM region)")
def source_text_lines(spark, sf):
    path = scratch_dir(spark, "lines")
    names = table(spark, sf, "nation").select("n_name").union(table(spark, sf, "region").select("r_name"))
    names.select(F.concat(F.lit("  "), "n_name", F.lit(" \n \n")).alias("value")).write.text(path)
    return questions.read_lines(spark, path)


@query("SELECT n_name, n_regionkey::INT AS n_regionkey FROM nation")
def source_repeated_header(spark, sf):
    """Files put together with their headers, which are rows then."""
    path = scratch_dir(spark, "headers")
    nations = table(spark, sf, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("n_regionkey"))
    header = spark.range(3).select(F.lit("n_name").alias("n_name"), F.lit("n_regionkey").alias("n_regionkey"))
    nations.unionByName(header).write.option("header", True).csv(path)
    found = questions.read_csv(spark, path, "n_name string, n_regionkey string", lists=(), header_of="n_regionkey")
    return found.select("n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


EVENTS = f"WITH {o.G4} SELECT game_id, n_items, mask, {r('value', 'value')} FROM u"


@query(EVENTS)
def saved_utilities(spark, sf):
    """Utilities saved in two runs that overlap, and loaded: each once."""
    path, u = scratch_dir(spark, "utilities"), games.event_game(spark, sf)
    rows = u.select("game_id", F.lit("users").alias("provider"), "n_items", "mask", "value", F.lit("count").alias("mode"))
    tables.save_utilities(rows.where("mask < 20"), path)
    tables.save_utilities(rows.where("mask > 10"), path)
    return rounded(tables.load_utilities(spark, path).select("game_id", "n_items", "mask", "value"))


@query(EVENTS)
def memoised_utilities(spark, sf):
    """What a provider has computed already isn't asked of it again: a second run of one that fails on old masks."""
    path, u = scratch_dir(spark, "utilities"), games.event_game(spark, sf).select("game_id", "mask", "value")
    wanted = coalitions.powerset(core.event_sizes(spark, sf))
    known = lambda rows: rows.join(u, ["game_id", "mask"])
    tables.evaluate_into(wanted.where("mask % 2 = 0"), path, "users", "count", known)
    strict = lambda rows: known(rows).withColumn("value", F.when(F.col("mask") % 2 == 0, F.raise_error(F.lit("asked again")).cast("double")).otherwise(F.col("value")))
    return rounded(tables.evaluate_into(wanted, path, "users", "count", strict).select("game_id", "n_items", "mask", "value"))


@query(f"WITH {o.G4}, {o.SHAPLEY} SELECT 'results' AS layout, game_id AS qid, item_idx, {r('phi', 'phi')} FROM shap UNION ALL SELECT 'extras', game_id, n_items, NULL FROM (SELECT DISTINCT game_id, n_items FROM u)")
def saved_results(spark, sf):
    """Attributions and extras in their layout, saved twice and loaded."""
    path, u = scratch_dir(spark, "results"), core.kept(games.event_game(spark, sf), "utilities")
    results = rounded(exact.shapley(u)).select(F.col("game_id").alias("qid"), F.lit("shapley").alias("method"), "item_idx", "phi")
    extras = games.games(u).select(F.col("game_id").alias("qid"), F.lit("shapley").alias("method"), F.lit("n_items").alias("name"), F.col("n_items").cast("string").alias("value"))
    tables.save_results(path, results, extras)
    tables.save_results(path, results.where("qid % 2 = 0"))
    found, more = tables.load_results(spark, path)
    return found.select(F.lit("results").alias("layout"), "qid", "item_idx", "phi").unionByName(more.select(F.lit("extras").alias("layout"), "qid", F.col("value").cast("int").alias("item_idx"), F.lit(None).cast("double").alias("phi")))


ROWS = f"WITH {o.METRIC} SELECT qid, metric, method, budget, {r('value', 'value')} FROM mr"


@query(ROWS)
def resumed_metrics(spark, sf):
    """A run that stopped half way, and one that does the rest."""
    path = scratch_dir(spark, "metrics")
    rows = core.metric_rows(spark, sf).select(F.col("qid").cast("bigint").alias("qid"), "metric", "method", "budget", F.lit(None).cast("int").alias("k"), F.col("value").cast("double").alias("value"))
    tables.append_metrics(rows.where("qid % 2 = 0"), path)
    tables.append_metrics(rows, path)
    return rounded(tables.load(spark, path, tables.METRICS).select("qid", "metric", "method", "budget", "value"))


@query(ROWS)
def sink_csv(spark, sf):
    path = scratch_dir(spark, "long")
    tables.write_csv(core.metric_rows(spark, sf).select("qid", "metric", "method", "budget", "value"), path)
    return rounded(spark.read.schema("qid bigint, metric string, method string, budget int, value double").option("header", True).csv(path))


def spread(spark, sf) -> DataFrame:
    """A report's columns out of exact ones: least and greatest difference, and their sum, instead of an interval."""
    pairs = core.kept(stats.against(core.metric_rows(spark, sf), core.BASE), "pairs")
    ends = pairs.groupBy(*core.PAIR_KEYS).agg(F.count(F.lit(1)).alias("n"), F.round(F.min(F.col("x") - F.col("y")) + F.max(F.col("x") - F.col("y")), 2).alias("point"), F.min(F.col("x") - F.col("y")).alias("low"), F.max(F.col("x") - F.col("y")).alias("high"))
    return ends.join(stats.win_tie_loss(pairs, core.PAIR_KEYS), core.PAIR_KEYS).withColumn("p_holm", F.lit(None).cast("double"))


SPREAD = f"WITH {o.AGAINST}, sp AS (SELECT metric, budget, method, count(*) AS n, round(min(d) + max(d), 2) AS point, min(d) AS low, max(d) AS high, count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d = 0) AS ties, count(*) FILTER (WHERE d < 0) AS losses FROM pr GROUP BY 1, 2, 3)"


@query(rf"{SPREAD} SELECT metric, budget, method, printf('%s & %.3f [%.3f, %.3f] & -- & %d/%d/%d \\', method, point::DOUBLE, low::DOUBLE, high::DOUBLE, wins, ties, losses) AS line FROM sp")
def sink_latex(spark, sf):
    return tables.latex_rows(spread(spark, sf))


@query(f"{SPREAD} SELECT metric, budget, method, printf('%s %d %s: %+.4f [%+.4f, %+.4f] W/T/L %d/%d/%d', metric, budget, method, point::DOUBLE, low::DOUBLE, high::DOUBLE, wins, ties, losses) AS line FROM sp")
def sink_text(spark, sf):
    return tables.report_lines(spread(spark, sf))


@query(f"{SPREAD} SELECT metric, method || '@' || budget AS name, {r('point', 'point')}, {r('low', 'low')}, {r('high', 'high')}, n::DOUBLE AS n FROM sp")
def sink_json(spark, sf):
    """The summary's JSON, and what a reader finds in it."""
    json = tables.summary_json(spread(spark, sf))
    cells = json.select("metric", F.explode(F.from_json("json", "map<string, array<double>>")).alias("name", "v"))
    return rounded(cells.select("metric", "name", F.col("v")[0].alias("point"), F.col("v")[1].alias("low"), F.col("v")[2].alias("high"), F.col("v")[3].alias("n")))


# Preparation


@query(f"WITH {TALKS}, g AS (SELECT conv_id, text FROM talks WHERE role = 'assistant'), k AS (SELECT t.conv_id, t.text, row_number() OVER (PARTITION BY t.conv_id ORDER BY role <> 'assistant', item) AS pos FROM talks t WHERE role = 'assistant' OR NOT EXISTS (SELECT 1 FROM g WHERE g.conv_id = t.conv_id AND g.text = t.text)) SELECT conv_id, string_agg(text, chr(10) ORDER BY pos) AS texts FROM k WHERE pos <= 10 GROUP BY conv_id")
def supporting_first(spark, sf):
    """Assistant turns first, then others that say something else, ten at most, which is the feature."""
    paragraphs = F.transform("t", lambda x: F.struct(x["text"].alias("text"), (x["role"] == "assistant").alias("is_supporting")))
    return talks(spark, sf).select("conv_id", F.array_join(prepare.supporting_first(paragraphs), "\n").alias("texts"))


@query(f"""WITH {TALKS}, s AS (SELECT conv_id, item, role, list_filter(list_transform({o.CUT}, lambda x: trim(x)), lambda x: x <> '') AS s FROM talks),
f AS (SELECT *, coalesce(sum(len(s)) OVER (PARTITION BY conv_id ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s)
SELECT conv_id, sum(len(s))::BIGINT AS n_sents, coalesce(string_agg(item, ',' ORDER BY item) FILTER (WHERE role = 'assistant'), '') AS gold_docs, coalesce(string_agg(off::BIGINT, ',' ORDER BY item) FILTER (WHERE role = 'assistant' AND len(s) > 0), '') AS gold_sents FROM f GROUP BY conv_id""")
def annotated_context(spark, sf):
    """Turns as titled documents; the first sentence of each assistant turn is a supporting fact, and so is a ninth that may not be there."""
    from tessera.functions.text import sentences

    title = lambda i: F.concat(F.lit("turn "), i.cast("string"))
    context = F.transform("t", lambda x, i: F.struct(title(i).alias("title"), sentences(x["text"]).alias("sents")))
    own = F.filter(F.transform("t", lambda x, i: F.when(x["role"] == "assistant", F.struct(title(i).alias("title"), F.lit(0).alias("sent_idx")))), lambda f: f.isNotNull())
    beyond = F.transform(own, lambda f: F.struct(f["title"].alias("title"), F.lit(10_000).alias("sent_idx")))
    rows = talks(spark, sf).select("conv_id", context.alias("context"), F.concat(own, beyond).alias("supporting_facts"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return prepare.annotate_context(rows).select("conv_id", F.size("sentences").cast("bigint").alias("n_sents"), listed("gold_docs").alias("gold_docs"), listed("gold_sents").alias("gold_sents"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'de'")
def rows_of_type(spark, sf):
    return table(spark, sf, "documents").where("lang = 'de'").select("doc_id", "source")


@query("SELECT p_partkey AS item_id, md5(concat_ws(' ', p_name, p_brand, p_type)) AS described FROM part")
def concatenated_text(spark, sf):
    """Columns dropped, renamed and put together as one text."""
    return table(spark, sf, "part").withColumnRenamed("p_partkey", "item_id").select("item_id", F.md5(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("described"))


@query(f"WITH {TALKS} SELECT conv_id, string_agg(text, chr(10) ORDER BY item) AS texts, count(*) AS n FROM talks WHERE item < 3 GROUP BY conv_id HAVING count(*) >= 2")
def first_items(spark, sf):
    """The first three turns, of conversations with two or more: the feature's own limit."""
    kept = prepare.first_items(talks(spark, sf), 3, "context")
    return kept.select("conv_id", F.array_join("context", "\n").alias("texts"), F.size("context").cast("bigint").alias("n"))


@query("""WITH b AS (SELECT DISTINCT item_id FROM benchmark WHERE item_id IS NOT NULL)
SELECT item_id, array_to_string(range(item_id % 4), ',') AS prefix, CASE WHEN item_id % 5 < 3 THEN array_to_string(range(2 + item_id % 5), ',') END AS of_type, CASE WHEN item_id % 3 = 0 THEN (item_id % 7)::VARCHAR END AS stored, CASE WHEN item_id % 2 = 0 THEN '0,' || (item_id % 9) END AS printed FROM b""")
def gold_providers(spark, sf):
    """Gold items as a prefix, by a question's type, from a stored table and from a printed list."""
    rows = table(spark, sf, "benchmark").where("item_id is not null").select("item_id").distinct()
    store = rows.where("item_id % 3 = 0").select("item_id", F.array((F.col("item_id") % 7).cast("int")).alias("gold"))
    kind = F.when(F.col("item_id") % 5 < 3, F.concat((2 + F.col("item_id") % 5).cast("string"), F.lit("hop"))).otherwise("comparison")
    cell = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("[0, "), (F.col("item_id") % 9).cast("string"), F.lit("]"))).otherwise("n/a")
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    found = prepare.stored_gold(rows, store, "item_id")
    return found.select("item_id", listed(prepare.gold_prefix((F.col("item_id") % 4).cast("int"))).alias("prefix"), listed(prepare.gold_of_type(kind)).alias("of_type"), listed("gold").alias("stored"), listed(prepare.printed_gold(cell)).alias("printed"))


@query(f"""WITH {o.G4}, {o.SHAPLEY}, k AS (SELECT game_id, item_idx, row_number() OVER (PARTITION BY game_id ORDER BY round(phi, 9) DESC, item_idx) AS place FROM shap),
c AS (SELECT 'first two' AS candidate, game_id, item_idx, 2 AS size FROM k WHERE item_idx < 2 UNION ALL SELECT 'odd', game_id, item_idx, 2 FROM k WHERE item_idx % 2 = 1 UNION ALL SELECT 'by day', game_id, item_idx, 1 + game_id % 5 FROM k WHERE item_idx <= game_id % 5),
s AS (SELECT candidate, c.game_id, count(*) FILTER (WHERE place <= size) / max(size) AS share FROM c JOIN k USING (game_id, item_idx) GROUP BY 1, 2) SELECT candidate, count(*) AS games, {r('avg(share)', 'overlap')} FROM s GROUP BY candidate""")
def gold_diagnostic(spark, sf):
    """How far three candidates for the gold items agree with the items of highest Shapley value."""
    phi = exact.shapley(games.event_game(spark, sf)).withColumn("phi", F.round("phi", 9))
    own = lambda name, which: phi.where(which).select(F.lit(name).alias("candidate"), "game_id", "item_idx")
    gold = own("first two", "item_idx < 2").unionByName(own("odd", "item_idx % 2 = 1")).unionByName(own("by day", "item_idx <= game_id % 5"))
    return rounded(prepare.gold_overlap(phi, gold))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def judged_correct(spark, sf):
    verdicts = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, " True ").otherwise("False").alias("verdict"))
    return prepare.only_judged(table(spark, sf, "documents"), verdicts, "doc_id").select("doc_id", "source")


# Utilities and providers


def hours(spark, sf) -> DataFrame:
    """(game_id, gone, token, p): of each day the distribution of events over hours, in full and without one or two event types."""
    events = table(spark, sf, "events")
    rows = events.join(F.broadcast(games.type_items(events)), "event_type").select(F.unix_date(F.to_date("ts")).cast("bigint").alias("game_id"), F.hour("ts").alias("token"), "item_idx")
    sets = F.array(F.lit(0), *(F.lit(1 << k) for k in range(games.TYPES)), F.lit(3))
    rows = rows.select("game_id", "token", "item_idx", F.explode(sets).alias("gone")).withColumn("gone", F.col("gone").cast("bigint")).where(~bits.has(F.col("gone"), F.col("item_idx")))
    counts = rows.groupBy("game_id", "gone", "token").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("game_id", "gone"))).drop("n")


@query(f"""WITH ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS item FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL) QUALIFY item < 5),
e AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE) AS game_id, hour(ts) AS token, item, gone FROM events JOIN ty USING (event_type), (VALUES (0), (1), (2), (3), (4), (8), (16)) g(gone) WHERE (gone >> item::INT) & 1 = 0),
c AS (SELECT game_id, gone, token, count(*) AS n FROM e GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY game_id, gone) AS p FROM c),
b AS (SELECT coalesce(s.game_id, x.game_id) AS game_id, coalesce(s.gone, x.gone) AS gone, coalesce(x.p, 0) + 1e-10 AS p, coalesce(s.p, 0) + 1e-10 AS q FROM (SELECT g.game_id, g.gone, f.token, f.p FROM (SELECT DISTINCT game_id, gone FROM p WHERE gone <> 0) g JOIN p f ON f.game_id = g.game_id AND f.gone = 0) s FULL JOIN (SELECT * FROM p WHERE gone <> 0) x ON x.game_id = s.game_id AND x.gone = s.gone AND x.token = s.token),
k AS (SELECT game_id, gone, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM b WINDOW w AS (PARTITION BY game_id, gone)), j AS (SELECT game_id, gone, sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2 AS jsd FROM k GROUP BY 1, 2)
SELECT game_id, gone::BIGINT AS gone, {r('jsd', 'jsd')}, {r('1 - exp(-jsd)', 'gain')} FROM j""")
def jsd_of_sets(spark, sf):
    """Leave-one-out by divergence, for each event type and for a set of two."""
    return rounded(exact.divergence_of_sets(hours(spark, sf)))


@query(f"WITH e AS (SELECT vec_id, embedding FROM embeddings) SELECT a.vec_id, {r('list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])', 'similarity', 5)} FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def generated_similarity(spark, sf):
    """The cosine of each vector and the next one, as of a generated answer and its reference."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("reference"))
    return rounded(v.join(other, "vec_id").select("vec_id", utilities.cosine(F.col("embedding"), F.col("reference")).alias("similarity")), 5)


@query(f"WITH {o.BEFORE}, t AS (SELECT conv_id, turn, array_to_string({o.tokens('text')}, ' ') AS x, array_to_string({o.tokens('before')}, ' ') AS y FROM b) SELECT conv_id, (x = y)::INT::DOUBLE AS value, count(*) AS n FROM t GROUP BY ALL")
def exact_match_utility(spark, sf):
    """Exact match as a utility: of each conversation, how many turns say what the one before does."""
    from tessera.functions.text import exact_match

    rows = core.exchanges(spark, sf).select("conv_id", exact_match(F.col("text"), F.col("before")).cast("double").alias("value"))
    return rows.groupBy("conv_id", "value").agg(F.count(F.lit(1)).alias("n"))


LOOKUPS = f"WITH {o.G4}, {o.DAYS}, {o.ORDER}, lk AS (SELECT game_id, iteration * 100 + position AS step, before AS mask FROM steps)"


@query(f"{LOOKUPS} SELECT game_id, count(*) AS lookups, count(DISTINCT mask) AS evaluations FROM lk GROUP BY game_id")
def counted_calls(spark, sf):
    steps = core.kept(lookups(spark, sf), "lookups")
    return providers.calls(steps).withColumnRenamed("n", "evaluations").join(steps.groupBy("game_id").agg(F.count(F.lit(1)).alias("lookups")), "game_id")


def lookups(spark, sf) -> DataFrame:
    return coalitions.permutations(core.event_sizes(spark, sf), core.ORDERS, core.SEED).select("game_id", (F.col("iteration") * 100 + F.col("position")).alias("step"), F.col("mask_before").alias("mask"))


@query(f"""{LOOKUPS}, f AS (SELECT *, (row_number() OVER (PARTITION BY game_id, mask ORDER BY step) = 1 AND mask <> 0)::INT AS new FROM lk), n AS (SELECT *, sum(new) OVER (PARTITION BY game_id ORDER BY step) AS spent FROM f),
p AS (SELECT *, max(spent) FILTER (WHERE new = 1) OVER (PARTITION BY game_id, mask) AS place FROM n)
SELECT p.game_id, step, p.mask, CASE WHEN place > 12 THEN -1.0 ELSE round(value, 6) + 0.0 END AS value, least(spent, 12)::BIGINT AS evaluations FROM p JOIN u ON u.game_id = p.game_id AND u.mask = p.mask""")
def budgeted_lookups(spark, sf):
    """Lookups along random orders with a budget of 12 evaluations, the empty coalition known; what is refused shows as -1."""
    u = core.kept(games.event_game(spark, sf), "utilities")
    found = providers.within_budget(lookups(spark, sf), u, 12, u.where("mask = 0"))
    return rounded(found.withColumn("value", F.when(F.col("value") == F.lit(float("-inf")), -1.0).otherwise(F.col("value"))))


# Coalitions of wide games

WIDE_ITEMS, WIDE_BUDGET = 40, 150
WIDE = f"s AS (SELECT n_nationkey::BIGINT AS game_id, (21 + n_nationkey % {WIDE_ITEMS - 20})::INT AS n FROM nation)"


def wide_games(spark, sf) -> DataFrame:
    """A game of 21 to 40 items for each nation."""
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("game_id"), (F.col("n_nationkey") % (WIDE_ITEMS - 20) + 21).cast("int").alias("n_items"))


def wide_sql(core_part: bool, neighbours: bool, fill: str | None) -> str:
    full = "((1::BIGINT << n) - 1)"
    parts = []
    if core_part:
        parts.append(f"SELECT game_id, n, 0::BIGINT AS mask, 0 AS rank, NULL::DOUBLE AS key FROM s UNION ALL SELECT game_id, n, {full}, 1, NULL FROM s")
    if neighbours:
        parts.append(f"SELECT game_id, n, 1::BIGINT << i::INT AS mask, 2 * i + 2 AS rank, NULL::DOUBLE AS key FROM (SELECT *, unnest(range(n)) AS i FROM s) UNION ALL SELECT game_id, n, xor({full}, 1::BIGINT << i::INT), 2 * i + 3, NULL FROM (SELECT *, unnest(range(n)) AS i FROM s)")
    more = ""
    if fill == "uniform":
        more = f", dr AS (SELECT game_id, n, draw, (({o.draw(repr('42:low'), 'game_id', 'draw')} & 1073741823) | (({o.draw(repr('42:high'), 'game_id', 'draw')} & 1073741823) << 30)) & {full} AS mask FROM t)"
    elif fill:
        weight = "(n - 1)::DOUBLE / (z * (n - z))" if fill == "kernelshap" else "1.0::DOUBLE"
        more = f""", law AS (SELECT n, z, {weight} AS w FROM (SELECT DISTINCT n, unnest(range(1, n)) AS z FROM s)), cum AS (SELECT n, z, coalesce(sum(w) OVER (PARTITION BY n ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(w) OVER (PARTITION BY n ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total FROM law),
a AS (SELECT game_id, t.n, draw, count(*) FILTER (WHERE below < {o.unit(repr('42:size'), 'game_id', 'draw')} * total) AS z FROM t JOIN cum ON cum.n = t.n GROUP BY ALL),
m AS (SELECT game_id, n, draw, z, i, row_number() OVER (PARTITION BY game_id, draw ORDER BY {o.draw(repr('42:member'), 'game_id', 'draw', 'i')}, i) AS pos FROM (SELECT *, unnest(range(n)) AS i FROM a)),
dr AS (SELECT game_id, n, draw, bit_or(CASE WHEN pos <= z THEN 1::BIGINT << i::INT ELSE 0 END) AS mask FROM m GROUP BY game_id, n, draw)"""
    if fill:
        parts.append("SELECT game_id, n, mask, NULL::INT AS rank, draw::DOUBLE AS key FROM dr")
    return f"""WITH {WIDE}, t AS (SELECT game_id, n, unnest(range(1, {coalitions.DRAWS * WIDE_BUDGET + 1})) AS draw FROM s){more}, al AS ({" UNION ALL ".join(parts)}), be AS (SELECT game_id, mask, min(rank) AS rank, min(key) AS key FROM al GROUP BY 1, 2)
SELECT game_id, mask, row_number() OVER (PARTITION BY game_id ORDER BY rank NULLS LAST, key, mask) AS ord FROM be QUALIFY ord <= {WIDE_BUDGET}"""


def wide(method: str) -> core.Query:
    return lambda spark, sf: coalitions.sample(wide_games(spark, sf), WIDE_BUDGET, method, core.SEED).select("game_id", "mask", "ord")


QUERIES |= {f"wide_{m}": wide(m) for m in ("uniform", "kernelshap", "bf", "bf_uniform", "bf_kernelshap")}
ORACLE |= {"wide_uniform": wide_sql(True, False, "uniform"), "wide_kernelshap": wide_sql(True, False, "kernelshap"), "wide_bf_uniform": wide_sql(True, True, "uniform"), "wide_bf_kernelshap": wide_sql(True, True, "kernelshap")}
ORACLE["wide_bf"] = f"""WITH {WIDE}, one AS (SELECT game_id, n, unnest(range(n)) AS i FROM s), sets AS (SELECT game_id, n, 0::BIGINT AS mask, 0 AS k, -1 AS a, -1 AS b FROM s UNION ALL SELECT game_id, n, 1::BIGINT << i::INT, 1, i, -1 FROM one
UNION ALL SELECT x.game_id, x.n, (1::BIGINT << x.i::INT) | (1::BIGINT << y.i::INT), 2, x.i, y.i FROM one x JOIN one y ON x.game_id = y.game_id AND x.i < y.i), both_sides AS (SELECT game_id, mask, k, 0 AS side, a, b FROM sets UNION ALL SELECT game_id, xor((1::BIGINT << n) - 1, mask), k, 1, a, b FROM sets)
SELECT game_id, mask, row_number() OVER (PARTITION BY game_id ORDER BY k, side, a, b) AS ord FROM both_sides QUALIFY ord <= {WIDE_BUDGET}"""


@query(wide_sql(False, True, "size_uniform"))
def wide_structured(spark, sf):
    return coalitions.structured_sample(wide_games(spark, sf), WIDE_BUDGET, core=False, fill="size_uniform", seed=core.SEED).select("game_id", "mask", "ord")


@query(f"WITH {WIDE} SELECT game_id, 2 * n + 2 AS floor, 2 * n + 2 AS rows FROM s")
def budget_floor(spark, sf):
    """How many coalitions the core and the neighbours take."""
    sizes = wide_games(spark, sf)
    drawn = coalitions.structured_sample(sizes, 1000, fill="none").groupBy("game_id").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.join(drawn, "game_id").select("game_id", coalitions.least_budget(F.col("n_items")).alias("floor"), "rows")


@query(f"""WITH {o.KERNEL_SIZES}, w AS (SELECT n, z, CASE WHEN {o.INNER} THEN {o.LAW} / {o.COUNT} ELSE 1000 END AS w, CASE WHEN z < n THEN factorial(n - 1)::DOUBLE / (factorial(z)::DOUBLE * factorial(greatest(n - 1 - z, 0))::DOUBLE) ELSE 0 END AS c FROM k WHERE n > 1)
SELECT n, z, {r('w / avg(w) OVER (PARTITION BY n)', 'mean_one')}, {r('c / sum(c) OVER (PARTITION BY n)', 'share')} FROM w""")
def normalised_kernels(spark, sf):
    """Kernel weights over their mean, and size weights over their sum."""
    rows = core.kernel_sizes(spark, sf).where("n > 1")
    return rounded(rows.select("n", "z", kernels.shap_kernel_mean_one(F.col("n"), F.col("z")).alias("mean_one"), kernels.size_kernel_share(F.col("n"), F.col("z")).alias("share")))


# Fits


@query(f"WITH {o.G4}, {o.LINEAR} SELECT u.game_id, n_items, mask, {r('any_value(b0) + coalesce(sum(phi) FILTER (WHERE ((mask >> item_idx) & 1) = 1), 0)', 'predicted')} FROM u JOIN icpt USING (game_id) JOIN banz USING (game_id) GROUP BY u.game_id, n_items, mask")
def predicted_utilities(spark, sf):
    u = core.kept(games.event_game(spark, sf), "utilities")
    return rounded(surrogates.predict(surrogates.fit_least_squares(u), u, 1))


@query(f"WITH {o.G4}, {o.SHAPLEY} SELECT u.game_id, n_items, mask, {r('coalesce(sum(phi) FILTER (WHERE ((mask >> item_idx) & 1) = 1), 0)', 'predicted')} FROM u JOIN shap USING (game_id) GROUP BY u.game_id, n_items, mask")
def predicted_by_attributions(spark, sf):
    """The sum of a coalition's attributions: a model without an intercept."""
    u = core.kept(games.event_game(spark, sf), "utilities")
    one = exact.shapley(u).select("game_id", bits.bit(F.col("item_idx")).alias("subset"), F.col("phi").alias("coef"))
    zero = games.games(u).select("game_id", F.lit(0).cast("bigint").alias("subset"), F.lit(0.0).alias("coef"))
    return rounded(surrogates.predict(zero.unionByName(one), u, 1))


@query(f"SELECT c_custkey, {r('sign(c_acctbal) * greatest(abs(c_acctbal) - 1000, 0)', 'soft', 4)}, {r('ln(1 + exp(-sign(c_nationkey - 12) * c_acctbal / 1000))', 'loss')} FROM customer")
def fit_helpers(spark, sf):
    balance = F.col("c_acctbal").cast("double")
    return rounded(table(spark, sf, "customer").select("c_custkey", F.round(surrogates.soft_threshold(balance, 1000.0), 4).alias("soft"), surrogates.pairwise_logistic(balance / 1000, F.col("c_nationkey").cast("double") - 12).alias("loss")))


@query(f"WITH {o.G4}, {o.SHAPLEY}, {o.MOBIUS}, f AS ({o.FAITHFUL.format('0', '-2.0/3 * ((v.s - 1) * (v.s - 2) / 2.0) / ((v.s + 1) * v.s * (v.s - 1) / 6.0)', '0.5 * ((v.s - 1) * (v.s - 2) / 2.0) / ((v.s + 1) * v.s * (v.s - 1) * (v.s - 2) / 24.0)')}) SELECT game_id, 1::BIGINT << item_idx AS subset, {r('phi', 'value')} FROM shap UNION ALL SELECT game_id, subset, coef FROM f WHERE bit_count(subset) = 2")
def exact_bundle(spark, sf):
    """The references that estimates are held against: Shapley values and faithful interactions of order two."""
    phi, pairs = exact.bundle(core.kept(games.event_game(spark, sf), "utilities"))
    two = pairs.select("game_id", bits.bit(F.col("i")).bitwiseOR(bits.bit(F.col("j"))).alias("subset"), "value")
    return rounded(phi.select("game_id", bits.bit(F.col("item_idx")).alias("subset"), F.col("phi").alias("value")).unionByName(two))


def closed_linear(weight: str, ridge: float = 0.0) -> str:
    """A linear fit whose weights depend on the size alone, in closed form: all items have one variance a and all pairs
    one covariance b, so the inverse of the Gram matrix is known."""
    return f"""WITH {o.G4}, w AS (SELECT game_id, mask, value, {weight} AS w FROM (SELECT *, n_items AS n, bit_count(mask)::INT AS z FROM u)), t AS (SELECT game_id, sum(w) AS tw, sum(w * value) AS twy, sum(w) FILTER (WHERE mask & 1 = 1) AS wx, sum(w) FILTER (WHERE mask & 3 = 3) AS wxx FROM w GROUP BY game_id),
g AS (SELECT *, wx - wx * wx / tw + {ridge}::DOUBLE AS a, wxx - wx * wx / tw AS b FROM t), c AS (SELECT w.game_id, i, sum(w * value) FILTER (WHERE (mask >> i::INT) & 1 = 1) AS wxy FROM w, range(5) k(i) GROUP BY 1, 2),
rr AS (SELECT game_id, i, wxy - wx * twy / tw AS r, a, b, wx, tw, twy FROM c JOIN g USING (game_id)), co AS (SELECT *, r / (a - b) - b / ((a - b) * (a - b + 5 * b)) * sum(r) OVER (PARTITION BY game_id) AS coef FROM rr)
SELECT game_id, 1::BIGINT << i::INT AS subset, {r('coef', 'coef')} FROM co UNION ALL SELECT game_id, 0, {r('max(twy / tw) - sum(coef * wx / tw)', 'coef')} FROM co GROUP BY game_id"""


@query(closed_linear(f"CASE WHEN {o.INNER} THEN {o.LAW} / {o.COUNT} ELSE 1000.0 END"))
def weighted_linear(spark, sf):
    """The fit by kernel weights."""
    return rounded(surrogates.fit_least_squares(core.weighted_train(spark, sf)))


@query(closed_linear("1.0::DOUBLE", 2.5))
def linear_ridge_fit(spark, sf):
    return rounded(surrogates.fit_least_squares(games.event_game(spark, sf), 1, ridge=2.5))


LASSO = f"WITH {o.G4}, {o.BANZHAF}, s AS (SELECT game_id, item_idx, sign(phi) * greatest(abs(phi) / 4 - 1, 0) * 4 AS coef FROM banz), m AS (SELECT game_id, avg(value) AS mean FROM u GROUP BY game_id)"


@query(f"{LASSO} SELECT game_id, 1::BIGINT << item_idx AS subset, {r('coef', 'coef')} FROM s UNION ALL SELECT game_id, 0, {r('max(mean) - sum(coef) / 2', 'coef')} FROM s JOIN m USING (game_id) GROUP BY game_id")
def lasso(spark, sf):
    """On all coalitions items are uncorrelated, so the lasso is a soft threshold of the covariances."""
    return rounded(surrogates.fit_least_squares(games.event_game(spark, sf), 1, lasso=1.0))


def machine(loss: str, rank: int = 4, digits: int = 6, **how) -> core.Query:
    """What a factorisation machine attributes to each item, as it was fitted."""
    return lambda spark, sf: rounded(surrogates.attributions(surrogates.fit_fm(games.segment_game(spark, sf), rank, loss, **how)), digits)


# The game's pairs are products of one number an item, so a machine of rank one without penalties settles at them.
QUERIES["fm_closed_form"] = machine("als", rank=1, digits=4, l2_w=0.0, l2_v=0.0, rounds=20_000, stop=1e-15)
ORACLE["fm_closed_form"] = o.ORACLE["fm_attributions"].replace(", 6)", ", 4)")
# Gradients come near a minimum that has no closed form; tests/test_games.py holds these fits against it.
QUERIES |= {name: machine(loss, steps=1500, rate=0.01) for name, loss in (("fm_gradient", "mixed"), ("fm_utility_loss", "utility"), ("fm_delta_loss", "delta"), ("fm_r2_loss", "r2"), ("fm_logistic_loss", "logistic"))}
QUERIES["fm_batches"] = machine("utility", steps=2000, rate=0.01, batch=16, l1=1e-5)


def ridge_hat(n: int, ridge: float) -> str:
    """Rows (subset, mask, h): the coefficient of a set is the sum of h times the utility of each coalition, and so is the mean."""
    names = surrogates.features(n, 2)
    x = np.array([[float(s & m == s) for s in names] for m in range(1 << n)])
    centred = x - x.mean(0)
    hat = np.linalg.solve(centred.T @ centred + ridge * np.eye(len(names)), centred.T)
    rows = [(s, m, hat[k, m]) for k, s in enumerate(names) for m in range(1 << n)]
    rows += [(0, m, 1 / (1 << n) - float(x.mean(0) @ hat[:, m])) for m in range(1 << n)]
    return ", ".join(f"({s}, {m}, {h!r}::DOUBLE)" for s, m, h in ((s, m, float(h)) for s, m, h in rows))


@query(f"WITH {o.G4}, h(subset, mask, h) AS (VALUES {ridge_hat(5, 0.5)}) SELECT game_id, subset::BIGINT AS subset, {r('sum(h * value)', 'coef')} FROM u JOIN h USING (mask) GROUP BY 1, 2")
def poly2_ridge(spark, sf):
    """The pairwise ridge fit to all coalitions, whose hat matrix no utility changes."""
    return rounded(surrogates.fit_least_squares(games.event_game(spark, sf), 2, ridge=0.5))


COPIED = f"""{o.TURNS}, copied AS (SELECT game_id, text, item, size + 1 AS size FROM held WHERE item < size - 1 UNION ALL SELECT game_id, text, size - 1, size + 1 FROM held WHERE item = 0 UNION ALL SELECT game_id, text, size, size + 1 FROM held WHERE item = size - 1),
twice AS (SELECT * FROM copied WHERE size - 2 >= 2)"""


@query(f"WITH {o.G2.replace(o.TURNS, COPIED).replace('FROM held)', 'FROM twice)')}, {o.SHAPLEY} SELECT game_id, {r('max(phi) FILTER (WHERE item_idx = 0)', 'first')}, {r('max(phi) FILTER (WHERE item_idx = n_items - 1)', 'copy')} FROM shap JOIN (SELECT DISTINCT game_id, n_items FROM u) USING (game_id) GROUP BY game_id")
def g6_symmetry(spark, sf):
    """The values of a turn and of its copy in one game: equal."""
    u = core.kept(games.duplicate_game(spark, sf), "duplicates")
    phi = exact.shapley(u).join(games.games(u), "game_id")
    pick = lambda at: F.max(F.when(F.col("item_idx") == at, F.col("phi")))
    return rounded(phi.groupBy("game_id").agg(pick(F.lit(0)).alias("first"), pick(F.col("n_items") - 1).alias("copy")))


# Statistics


@query(f"SELECT c_custkey AS qid, k, {r('c_acctbal / k', 'value')} FROM customer, (VALUES (1), (5), (10)) v(k)")
def metrics_by_k(spark, sf):
    wide = table(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), F.array(*((F.col("c_acctbal") / k).cast("double") for k in (1, 5, 10))).alias("values"))
    return rounded(stats.by_k(wide, ["qid"], "values", [1, 5, 10]))


@query(f"WITH {o.METRIC} SELECT 'one' AS which, qid, {r('value', 'value')} FROM mr WHERE method = '5-LOW' AND budget = 1996 UNION ALL SELECT 'all', qid, {r('value', 'value')} FROM mr WHERE method = '5-LOW'")
def filtered_series(spark, sf):
    """A method's values at one budget, and at all of them; at none there are none."""
    rows = core.metric_rows(spark, sf)
    own = lambda which, **how: stats.series(rows, "price", "5-LOW", **how).withColumn("which", F.lit(which))
    return rounded(own("one", budget=1996).unionByName(own("all", any_budget=True)).unionByName(own("none")).select("which", "qid", "value"))


HOLM = "(count(*) OVER (PARTITION BY {0}) - row_number() OVER (PARTITION BY {0} ORDER BY p) + 1) * p"


@query(f"WITH {o.METRIC}, t AS (SELECT method, budget, 1 / count(*)::DOUBLE + row_number() OVER (ORDER BY method, budget) / 1e6 AS p FROM mr GROUP BY 1, 2), s AS (SELECT *, {HOLM.format('budget')} AS a, {HOLM.format('method')} AS b FROM t) SELECT method, budget, {r('least(1, max(a) OVER (PARTITION BY budget ORDER BY p ROWS UNBOUNDED PRECEDING))', 'by_budget')}, {r('least(1, max(b) OVER (PARTITION BY method ORDER BY p ROWS UNBOUNDED PRECEDING))', 'by_method')} FROM s")
def holm_families(spark, sf):
    """Corrections within budgets and within methods, of p values made from the cells' sizes."""
    cells = core.metric_rows(spark, sf).groupBy("method", "budget").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select("method", "budget", (1 / F.col("n") + F.row_number().over(Window.orderBy("method", "budget")) / 1e6).alias("p"))
    one, two = (stats.holm(cells, [k]).withColumnRenamed("p_holm", f"by_{k}") for k in ("budget", "method"))
    return rounded(one.join(two.select("method", "budget", "by_method"), ["method", "budget"]).select("method", "budget", "by_budget", "by_method"))


@query(f"WITH {o.METRIC} SELECT metric, method, budget, count(*) AS n, {r('2.8015852181104035 * stddev_samp(value) / sqrt(count(*))', 'effect', 2)} FROM mr GROUP BY 1, 2, 3")
def detectable_effects(spark, sf):
    """The normal quantiles of 0.975 and 0.8 add up to 2.8015852181104035."""
    return rounded(stats.detectable_effects(core.metric_rows(spark, sf)), 2)


@query(f"WITH {o.METRIC} SELECT metric, method, {r('avg(value) FILTER (WHERE qid % 3 = 0)', 'k0')}, {r('avg(value) FILTER (WHERE qid % 3 = 1)', 'k1')}, {r('avg(value) FILTER (WHERE qid % 3 = 2)', 'k2')} FROM mr WHERE budget = 1996 GROUP BY 1, 2")
def fixed_budget_by_k(spark, sf):
    rows = core.metric_rows(spark, sf).withColumn("k", (F.col("qid") % 3).cast("int"))
    return rounded(stats.by_k_table(rows, 1996, [0, 1, 2]).withColumnsRenamed({str(k): f"k{k}" for k in range(3)}))


@query(f"""WITH {o.G4}, v(place, name, core, near, evenly) AS (VALUES (0, 'full', true, true, false), (1, 'no core', false, true, false), (2, 'no neighbours', true, false, false), (3, 'uniform fill', true, true, true), (4, 'uniform only', false, false, true), (5, 'size-uniform fill', true, true, false)),
m AS (SELECT game_id, n_items AS n, bit_count(mask)::INT AS z FROM u)
SELECT game_id, place, name, least(40, count(*)) AS n FROM m, v WHERE evenly OR (z > 0 AND z < n) OR (core AND z IN (0, n)) GROUP BY game_id, place, name""")
def variant_groups(spark, sf):
    """The full system and the variants of one group, with the coalitions that each evaluates of a day."""
    return ablation.evaluations(games.event_game(spark, sf), ablation.variants(("sampling",)), 40)


@query()
def mean_ranks(spark, sf):
    """The mean rank that the full system chooses at two budgets."""
    return rounded(ablation.rank_log(core.kept(games.event_game(spark, sf), "utilities"), [12, 24]))


@query()
def rank_oracle(spark, sf):
    """Of each game the rank whose machine orders the items best, by the exact values: a ceiling for the rules that choose one."""
    return rounded(ablation.rank_oracle(core.kept(games.event_game(spark, sf), "utilities"), core.BUDGET), 3)


@query(f"WITH {o.METRIC} SELECT method, budget, count(*) AS n, {r('avg(value)', 'point', 3)}, true AS holds FROM mr GROUP BY 1, 2")
def bootstrap_brackets(spark, sf):
    """Sizes and means, and that intervals hold them."""
    got = stats.bootstrap_ci(core.metric_rows(spark, sf), ["metric", "method", "budget"])
    return got.select("method", "budget", "n", F.round("point", 3).alias("point"), ((F.col("low") <= F.col("point") + 1e-9) & (F.col("point") <= F.col("high") + 1e-9)).alias("holds"))


@query()
def interval_summary(spark, sf):
    return rounded(stats.interval_summary(core.metric_rows(spark, sf)), 3)
