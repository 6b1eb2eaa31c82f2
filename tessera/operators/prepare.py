"""From question tables to items: order, cut, duplicate and mark the documents of each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import bits
from tessera.functions.text import sentences


def ablated(items: Column, mask: Column, separator: str = "\n\n") -> Column:
    """The text of a coalition: its items in order."""
    return F.array_join(F.filter(items, lambda x, i: bits.has(mask, i)), separator)


def removed(n: Column, gone: Column) -> Column:
    """Mask of n items without those at the indices in the array `gone`."""
    return F.aggregate(F.array_distinct(gone), bits.full(n), lambda m, i: bits.without(m, bits.bit(i)))


def gold_first(documents: Column, gold: Column, most: int | None = None) -> Column:
    """Documents whose index is in `gold` first, then the others, both in order."""
    n = F.size(documents)
    order = F.concat(F.filter(bits.items(n), lambda i: F.array_contains(gold, i)), F.filter(bits.items(n), lambda i: ~F.array_contains(gold, i)))
    sorted_docs = F.transform(order, lambda i: F.get(documents, i))
    return F.slice(sorted_docs, 1, most) if most else sorted_docs


def supporting_first(paragraphs: Column, most: int = 10) -> Column:
    """From structs (text, is_supporting): supporting texts, then the others that aren't textually one of them."""
    gold = F.transform(F.filter(paragraphs, lambda p: p["is_supporting"]), lambda p: p["text"])
    rest = F.transform(F.filter(paragraphs, lambda p: ~p["is_supporting"] & ~F.array_contains(gold, p["text"])), lambda p: p["text"])
    return F.slice(F.concat(gold, rest), 1, most)


def with_duplicate(documents: Column, item: int = 1, at: int = 5) -> Column:
    """The documents with a copy of one of them put in at a place; unchanged if there is no such item."""
    n = F.size(documents)
    head, tail = F.slice(documents, 1, at), F.slice(documents, F.lit(at + 1), F.greatest(n - at, F.lit(0)))
    return F.when(n > item, F.concat(head, F.slice(documents, item + 1, 1), tail)).otherwise(documents)


def first_items(questions: DataFrame, most: int, column: str = "documents", least: int = 2) -> DataFrame:
    """The first `most` documents; questions with fewer than `least` go."""
    return questions.withColumn(column, F.slice(column, 1, most)).where(F.size(column) >= least)


def sentence_items(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, sentence_idx, sentence): ids are columns, not prefixes of the text."""
    return documents.select(key, F.posexplode(sentences(F.col(text))).alias("sentence_idx", "sentence"))


def annotate_context(questions: DataFrame) -> DataFrame:
    """From context array<struct<title, sents>> and supporting_facts array<struct<title, sent_idx>>: documents (texts),
    sentences (all in order), gold_docs and gold_sents, the latter by a running offset; facts beyond a text's end are no gold."""
    context, facts = F.col("context"), F.col("supporting_facts")
    offset = lambda d: F.aggregate(F.slice(context, F.lit(1), d), F.lit(0), lambda n, c: n + F.size(c["sents"]))
    is_fact = lambda title, s: F.exists(facts, lambda f: (f["title"] == title) & (f["sent_idx"] == s))
    gold_docs = F.filter(F.transform(context, lambda c, d: F.when(F.exists(facts, lambda f: f["title"] == c["title"]), d)), lambda d: d.isNotNull())
    gold_sents = F.flatten(F.transform(context, lambda c, d: F.filter(F.transform(c["sents"], lambda _, s: F.when(is_fact(c["title"], s), offset(d) + s)), lambda x: x.isNotNull())))
    return questions.select("*", F.transform(context, lambda c: F.array_join(c["sents"], " ")).alias("documents"), F.flatten(F.transform(context, lambda c: c["sents"])).alias("sentences"), gold_docs.alias("gold_docs"), gold_sents.alias("gold_sents"))


def gold_prefix(size: Column) -> Column:
    """Gold items 0 .. size - 1, for documents that are sorted gold first."""
    return bits.items(size)


def gold_of_type(kind: Column) -> Column:
    """Gold items of a question of type "2hop", "3hop" ...: as many as the number says; null for others."""
    return F.when(kind.rlike(r"^\d+hop"), bits.items(F.regexp_extract(kind, r"^(\d+)hop", 1).try_cast("int")))


def lookup_answers(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """`left` with `value` from `right` by the trimmed text key, where all rows of a key agree, and `status`: found,
    conflict or missing. Null values don't conflict with one that is there."""
    trimmed = F.trim(F.col(key))
    known = right.groupBy(trimmed.alias("k")).agg(F.count_distinct(value).alias("n"), F.min(value).alias("v")).where("n > 0")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "conflict").otherwise("found")
    return left.withColumn("__k", trimmed).join(known, F.col("__k") == F.col("k"), "left").select(*(F.col(c) for c in left.columns), F.when(F.col("n") == 1, F.col("v")).alias(value), status.alias("status"))


def only_judged(questions: DataFrame, verdicts: DataFrame, key: str, correct: bool = True) -> DataFrame:
    """Questions whose verdict, a text or boolean, is the wanted one."""
    good = verdicts.where(F.lower(F.trim(F.col("verdict").cast("string"))) == str(correct).lower()).select(key).distinct()
    return questions.join(good, key, "left_semi")


def scaled(rows: DataFrame, keys: list[str], columns: list[str], how: str = "separate") -> DataFrame:
    """Columns scaled within each key: "joint" and "separate" to 0..1, over all columns or each; "shift" to a least of 0.
    What doesn't vary becomes 0."""
    game = Window.partitionBy(*keys)
    low = {c: F.min(c).over(game) for c in columns}
    high = {c: F.max(c).over(game) for c in columns}
    if how == "joint":
        low = dict.fromkeys(columns, F.least(*low.values()) if len(columns) > 1 else low[columns[0]])
        high = dict.fromkeys(columns, F.greatest(*high.values()) if len(columns) > 1 else high[columns[0]])
    elif how not in ("separate", "shift"):
        raise ValueError(f"unknown scaling {how!r}")
    part = lambda c: F.col(c) - low[c] if how == "shift" else F.when(high[c] > low[c], (F.col(c) - low[c]) / (high[c] - low[c])).otherwise(F.lit(0.0))
    return rows.withColumns({c: part(c) for c in columns})


def without_header_rows(rows: DataFrame, column: str) -> DataFrame:
    """Rows of a text table that repeat its header go."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(column)))


def stored_gold(questions: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """`questions` with gold, an array of item indices, from a table of (key, gold); null where none is stored."""
    one = gold.groupBy(key).agg(F.max("gold").alias("gold"))
    return questions.join(one, key, "left")


def printed_gold(cell: Column) -> Column:
    """Item indices from a cell such as "[0, 2]"; null for cells that are no list of whole numbers."""
    return F.from_json(F.when(cell.rlike(r"^\s*\[\s*(\d+\s*(,\s*\d+\s*)*)?\]\s*$"), cell), "array<int>")


def gold_overlap(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """(candidate, games, overlap): how well each candidate for the gold items agrees with the scores.

    `scores` (game_id, item_idx, phi), `gold` (candidate, game_id, item_idx). Of each game, the share of the candidate's
    items that are among as many items of highest phi, ties to the smaller item; its mean over the games that have some.
    """
    place = F.row_number().over(Window.partitionBy("game_id").orderBy(F.col("phi").desc(), "item_idx"))
    ranked = scores.withColumn("place", place).select("game_id", "item_idx", "place")
    own = gold.select("candidate", "game_id", "item_idx").distinct()
    size = own.groupBy("candidate", "game_id").agg(F.count(F.lit(1)).alias("size"))
    met = size.join(own, ["candidate", "game_id"]).join(ranked, ["game_id", "item_idx"], "left")
    share = met.groupBy("candidate", "game_id", "size").agg((F.count_if(F.col("place") <= F.col("size")) / F.col("size")).alias("share"))
    return share.groupBy("candidate").agg(F.count(F.lit(1)).alias("games"), F.avg("share").alias("overlap"))
