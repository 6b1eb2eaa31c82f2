"""Finding benchmark items inside documents by size-partitioned MinHash containment, in DataFrame functions alone."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free, small, words, written

SHINGLE, CONTAINED = 5, 0.8
#: Size ranges of the items by their distinct shingles, from the second number of the row before on, with the MinHash
#: values of each range's sketch: None for all of them.
RANGES = ((16, None), (32, 16), (64, 20), (128, 24), (512, 32), (2**62, 40))
#: Chance that an item contained in just `CONTAINED` of its shingles is not a candidate.
MISSED = 1e-6


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Word shingles in lower case, as strings, repeats included; a shorter text's words are one; no words, none."""
    return _each(words(text), lambda own, i: F.concat_ws(" ", F.slice(own, i, n)), n)


def shingle_keys(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of the shingles, each from the hashes of its words."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    return _each(hashed, lambda own, i: F.xxhash64(*(F.get(own, i - 1 + k) for k in range(n))), n)


def _each(own: Column, f, n: int) -> Column:
    several = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - (n - 1), F.lit(1))), lambda i: f(x, i))
    return F.element_at(F.transform(F.array(own), lambda x: F.when(F.size(x) > 0, several(x)).otherwise(F.slice(several(x), 1, 0))), 1)


def hits_needed(size: int, contained: float = CONTAINED, missed: float = MISSED) -> int:
    """Sketch hits that an item contained in `contained` of its shingles has but with chance `missed`."""
    below = 0.0
    for hits in range(size + 1):
        below += comb(size, hits) * contained**hits * (1 - contained) ** (size - hits)
        if below > missed:
            return max(1, hits)
    return size


def item_key() -> Column:
    """Items are told apart by id and text."""
    return F.struct(F.col("item_id").alias("id"), F.xxhash64("text").alias("text"))


def item_table(items: DataFrame, ranges: tuple = RANGES, contained: float = CONTAINED) -> DataFrame:
    """(item, part, size, keys, least, sketch, hits): an item's shingles, its size range and its MinHash sketch.

    Items are partitioned by size, and each range has a sketch size and a threshold of its own. Where the sketch is
    the whole item it needs the share itself; a larger item is sketched by so many of its smallest shingle hashes and
    needs hits_needed() of them, of which the share in a document estimates the containment however much longer the
    document is.
    """
    keyed = items.select(item_key().alias("item"), F.array_sort(F.array_distinct(shingle_keys(F.col("text").cast("string")))).alias("keys")).where(F.size("keys") > 0)
    size = F.size("keys")
    least = F.ceil(contained * size - 1e-9)
    part = sketch = hits = None
    for k, (most, n) in enumerate(ranges):
        own = (F.lit(k), F.col("keys") if n is None else F.slice("keys", 1, n), least if n is None else F.lit(hits_needed(n, contained)).cast("bigint"))
        here = size <= most
        part, sketch, hits = (F.when(here, v) if c is None else c.when(here, v) for c, v in zip((part, sketch, hits), own, strict=True))
    return keyed.select("item", part.alias("part"), size.alias("size"), "keys", least.alias("least"), sketch.alias("sketch"), hits.alias("hits"))


def contained_items(docs: DataFrame, items: DataFrame, contained: float = CONTAINED, ranges: tuple = RANGES) -> DataFrame:
    """(doc_id, text_key, item_id, item_shingles, shared, containment) of the items with `contained` of their distinct
    5-word shingles, or more, in the text of a document.

    Candidates: documents with enough of an item's sketch, of at least the size that containment needs. A document
    meets a size range by those of its own shingles that can be in a sketch there: the hashes up to the greatest one
    of the range's sketches, which for large items is a small part of them. Only candidates' texts are shingled once
    more, as strings, and compared with the whole items. Nulls and texts without words contain
    nothing and are contained nowhere. Documents are told apart by id and text, so repeated ids don't mix; rows that
    repeat whole give one. Items that repeat by id and text count once; a null item_id stays null.
    """
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    items = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    table = written(item_table(items, ranges, contained), "benchmark-items")
    marks = table.select("item", "size", "least", "hits", F.explode("sketch").alias("key"))
    bounds = table.agg(F.max(F.element_at("sketch", -1)).alias("top"), F.min("least").alias("least")).first()
    keyed = docs.select("doc_id", "text_key", shingle_keys(F.col("text")).alias("keys"))
    keyed = keyed.where(F.size("keys") >= (bounds["least"] or 0)).select("doc_id", "text_key", F.size("keys").alias("n"), F.explode("keys").alias("key"))
    met = keyed.where(F.col("key") <= F.lit(bounds["top"])).join(small(marks), "key").where(F.col("n") >= F.col("least"))
    found = met.groupBy("doc_id", "text_key", "item", "size", "hits").agg(F.count_distinct("key").alias("got")).where("got >= hits")
    found = written(found.select("doc_id", "text_key", "item"), "benchmark-candidates")
    ids = found.select("doc_id", "text_key").distinct()
    few = docs.join(small(ids), docs["doc_id"].eqNullSafe(ids["doc_id"]) & docs["text_key"].eqNullSafe(ids["text_key"]), "left_semi")
    exact = few.select("doc_id", "text_key", F.explode(F.array_distinct(shingles(F.col("text")))).alias("shingle"))
    whole = items.select(item_key().alias("item"), F.array_distinct(shingles(F.col("text"))).alias("all")).where(F.size("all") > 0)
    whole = whole.select("item", F.size("all").cast("bigint").alias("item_shingles"), F.explode("all").alias("shingle"))
    pairs = exact.join(small(whole), "shingle").groupBy("doc_id", "text_key", "item", "item_shingles").agg(F.count(F.lit(1)).alias("shared"))
    pairs = pairs.where(F.col("shared") >= F.ceil(contained * F.col("item_shingles") - 1e-9))
    sure = pairs.join(found.withColumnsRenamed({c: f"c_{c}" for c in found.columns}), F.col("doc_id").eqNullSafe(F.col("c_doc_id")) & F.col("text_key").eqNullSafe(F.col("c_text_key")) & F.col("item").eqNullSafe(F.col("c_item")), "left_semi")
    return sure.select("doc_id", "text_key", F.col("item")["id"].alias("item_id"), "item_shingles", "shared", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, contained: float = CONTAINED, ranges: tuple = RANGES) -> DataFrame:
    """`docs` without the documents that contain an item; the columns stay as they are, whatever they are called.

    Null and empty texts contain nothing and stay; an item in just `contained` of its shingles counts; rows that
    repeat stay or go together; no items remove nothing.
    """
    names = list(docs.columns)
    key, doc_id, text_key = free(names, "key"), free(names, "b_doc_id"), free(names, "b_text_key")
    bad = written(contained_items(docs, items, contained, ranges).select(F.col("doc_id").alias(doc_id), F.col("text_key").alias(text_key)).distinct(), "contaminated")
    keyed = docs.select("*", F.xxhash64(F.col("text").cast("string")).alias(key))
    return keyed.join(small(bad), F.col("doc_id").eqNullSafe(F.col(doc_id)) & F.col(key).eqNullSafe(F.col(text_key)), "left_anti").drop(key)
