"""Queries of this subpackage, each an operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact, lines, lm, packing, quality, rules, simhash, toxicity, tries, vectors, warc, wrappers

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_pages(table(spark, sf_dir, "pages"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_pages(spark, warc.archive(table(spark, sf_dir, "pages")))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.length("cleaned").cast("bigint").alias("cleaned_chars"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.compress(table(spark, sf_dir, "embeddings"))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents"))


def op13_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_tree(table(spark, sf_dir, "conversations"))


OPERATORS = (op1_quality, op2_extract, op3_pack, op4_lm, op5_simhash, op6_warc, op7_lines, op8_rules, op9_toxicity, op10_decontaminate, op11_vectors, op12_exact, op13_tries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}

BLANK = r"[\x20\x09-\x0D]+"
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WARC_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
s AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS top, array_to_string([
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1)
  for k in range(32)], '') AS payload_digest FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM d"""

LINES_SQL = rf"""
WITH page AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
line AS (SELECT rid, source, x, n, regexp_replace(x, '^{BLANK}|{BLANK}$', '', 'g') AS norm FROM
  (SELECT rid, source, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS n FROM page)),
size AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
often AS (SELECT source, norm FROM (SELECT DISTINCT rid, source, norm FROM line WHERE norm <> '') JOIN size USING (source)
  GROUP BY source, norm, pages HAVING count(*) >= {lines.PAGES} AND count(*) > {lines.RATIO}::DOUBLE * pages),
cut AS (SELECT rid, n, x, o.norm IS NOT NULL AS gone FROM line l LEFT JOIN often o ON l.source = o.source AND l.norm = o.norm),
whole AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, string_agg(x, chr(10) ORDER BY n) FILTER (WHERE NOT gone) AS left_over FROM cut GROUP BY rid)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(left_over, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM page LEFT JOIN whole USING (rid)"""


def found(expr: str, chars: str) -> str:
    return f"len(regexp_extract_all({expr}, '[{chars}]'))"


def solid(expr: str) -> str:
    return f"(length({expr}) - {found(expr, rules.BLANKS)})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


RULES_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, [x for x in string_split_regex(text, '{BLANK}') if x <> ''] AS own FROM t),
win AS (SELECT rid, i, array_to_string(own[i:i + 7], ' ') AS k FROM (SELECT rid, own, unnest(range(1, len(own) - 6)) AS i FROM w WHERE len(own) > 8)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
again AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + j AS at FROM twice, range(8) r(j)) GROUP BY rid),
line AS (SELECT rid, n, x, lower(x) AS low, [w for w in string_split_regex(x, '{BLANK}') if w <> ''] AS lw, {solid("x")} AS solid FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS n FROM t)),
open AS (SELECT *, sum((solid = 0)::INT) OVER (PARTITION BY rid ORDER BY n) AS para, lag(x) OVER (PARTITION BY rid ORDER BY n) AS before, lag(solid) OVER (PARTITION BY rid ORDER BY n) AS held FROM line),
wrapped AS (SELECT rid, 2 * count(*) FILTER (WHERE regexp_matches(x, {quoted(rules.GOES_ON)})) >= count(*) AS wraps FROM open WHERE solid > 0 AND held > 0 AND NOT regexp_matches(before, {quoted(rules.COMPLETE)}) GROUP BY rid),
ends AS (SELECT open.*, CASE WHEN wraps THEN bool_or(regexp_matches(x, '{rules.SENTENCE_END}')) OVER (PARTITION BY rid, para) ELSE regexp_matches(x, '{rules.SENTENCE_END}') END AS ended FROM open LEFT JOIN wrapped USING (rid)),
judged AS (SELECT rid, n, x, solid, ({found("x", rules.SYMBOLS)} > 1 AND {found("x", rules.SYMBOLS)} > 0.05::DOUBLE * solid) OR ({found("x", "!")} > 1 AND {found("x", "!")} > 0.05::DOUBLE * solid) OR ({found("x", rules.BRACKETS)} > 1 AND {found("x", rules.BRACKETS)} > 0.1::DOUBLE * solid)
  OR ({found("x", rules.BARS)} >= 2 AND {found("x", rules.BARS)} * 40 > solid)
  OR regexp_matches(x, {quoted(rules.MENU)}, 'i')
  OR (len(lw) > 0 AND {rules.NOTICE_PART} * (length(x) - length(regexp_replace(x, {quoted(rules.NOTICE)}, '', 'gi'))) >= solid)
  OR (len(lw) > 0 AND regexp_matches(x, '{rules.ADDRESS}') AND 2 * len(regexp_extract_all(x, '{rules.ADDRESS}')) >= len(lw))
  OR (len(lw) >= {rules.REPEAT_WORDS} AND 4 * len(list_distinct(lw)) < len(lw))
  OR (len(lw) >= {rules.SOUP_WORDS} AND NOT ended) AS fails FROM ends),
cleaned AS (SELECT rid, coalesce(string_agg(x, chr(10) ORDER BY n) FILTER (WHERE NOT fails), '') AS cleaned,
  count(*) FILTER (WHERE solid > 0) - count(DISTINCT x) FILTER (WHERE solid > 0) AS n_dup_lines FROM judged GROUP BY rid),
base AS (SELECT doc_id, len(own) AS n_words, {solid("text")} AS word_chars, {found("text", rules.SYMBOLS)} AS n_symbols,
  n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, cleaned FROM w JOIN cleaned USING (rid) LEFT JOIN again USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {solid("cleaned")} >= 0.5::DOUBLE * word_chars AS kept, length(cleaned) AS cleaned_chars FROM base"""

CONTAINED_SQL = rf"""
WITH dw AS (SELECT doc_id, text, [x for x in string_split_regex({FOLDED}, '{BLANK}') if x <> ''] AS w FROM documents),
iw AS (SELECT DISTINCT item_id, text, [x for x in string_split_regex({FOLDED}, '{BLANK}') if x <> ''] AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, text, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)]) AS s FROM dw WHERE len(w) > 0),
sh AS (SELECT DISTINCT item_id, text, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)]) AS s FROM iw WHERE len(w) > 0),
size AS (SELECT item_id, text, count(*) AS item_shingles FROM sh GROUP BY item_id, text)
SELECT doc_id, sh.item_id, item_shingles, count(*) AS shared, count(*) / item_shingles AS containment
FROM ds JOIN sh ON ds.s = sh.s JOIN size ON sh.item_id IS NOT DISTINCT FROM size.item_id AND sh.text = size.text
GROUP BY doc_id, ds.text, sh.item_id, sh.text, item_shingles HAVING count(*) >= ceil(0.8::DOUBLE * item_shingles - 1e-9)"""

EXACT_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, sha256(regexp_replace(coalesce(text, ''), '{BLANK}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER same = 1 AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, rid)"""


def vectors_sql(parts: int = vectors.PARTS, entries: int = vectors.ENTRIES, rounds: int = vectors.ROUNDS, scale: int = vectors.SCALE) -> str:
    """Assignments and means of all rounds, one after the other; a distance and its entry are one number, so ties go low."""
    away = "list_sum([(x[k] - c.x[k]) * (x[k] - c.x[k]) for k in range(1, len(x) + 1)])"
    steps = [
        f"kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)",
        f"part AS (SELECT rid, p, v[1 + p * len(v) // {parts}:(p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) r(p))",
        f"c0 AS (SELECT p, rid - 1 AS e, x FROM part WHERE rid <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS (SELECT rid, p, any_value(x) AS x, min({away} * {entries} + e) AS best FROM (SELECT part.rid, part.p, part.x AS x, c.e, c FROM part JOIN c{k} c ON c.p = part.p) GROUP BY rid, p)")
        if k < rounds:
            steps.append(f"s{k} AS (SELECT p, best % {entries} AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{k}, range(1, 1 + (SELECT max(len(x)) FROM part)) r(i) GROUP BY ALL)")
            steps.append(f"c{k + 1} AS (SELECT p, e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{k} GROUP BY p, e) m USING (p, e))")
    steps.append(f"done AS (SELECT rid, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY rid)")
    steps.append(f"book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM c{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN done USING (rid), book"


#: crc32 of the decimal id, bit by bit.
CRC_SQL = "xor(4294967295, list_reduce([4294967295] || [ascii(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')], lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT for k in range(8)], lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"
TRIE_SQL = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rank FROM conversations WHERE conv_id IS NOT NULL),
info AS (SELECT conv_id, {CRC_SQL} % {tries.HEAD} AS h, conv_id - conv_id % {tries.BLOCK} AS base FROM (SELECT DISTINCT conv_id FROM t)),
moved AS (SELECT i.conv_id, 0 AS own, rank, role, text FROM info i JOIN t ON t.conv_id = i.base AND rank <= h UNION ALL SELECT conv_id, 1, rank, role, text FROM info i JOIN t USING (conv_id) WHERE rank > h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, rank) AS depth, md5(length(role) || ' ' || role || text) AS said, len([w for w in string_split_regex(text, '{BLANK}') if w <> '']) AS words FROM moved),
p AS (SELECT conv_id, depth, words, md5(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM info),
node AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words FROM p GROUP BY k, depth),
up AS (SELECT n.k, q.k AS above, parent.conv_id AS parent_conv_id FROM node n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1 LEFT JOIN node parent ON parent.k = q.k),
below AS (SELECT above AS k, count(*) AS n FROM up WHERE above IS NOT NULL GROUP BY above),
own AS (SELECT node.*, coalesce(below.n, 0) AS n_children, (n_convs - 1) * words AS saved FROM node LEFT JOIN below USING (k)),
under AS (SELECT p.k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM own JOIN p ON p.conv_id = own.conv_id AND p.depth <= own.depth GROUP BY p.k),
ends AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, k FROM p QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY k)
SELECT own.conv_id, own.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN up USING (k) JOIN under USING (k) LEFT JOIN ends USING (k)"""

ORACLE: dict[str, str] = {"op11_vectors": vectors_sql(), "op12_exact": EXACT_SQL, "op13_tries": TRIE_SQL, "op6_warc": WARC_SQL, "op7_lines": LINES_SQL, "op8_rules": RULES_SQL, "op10_decontaminate": CONTAINED_SQL}
