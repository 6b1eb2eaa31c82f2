"""Exact duplicates against a persistent index of digests, which is bucketed and sorted by the digest."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BLANK, scratch, with_values, written

#: Parts that documents arrive in at the query, by id.
ARRIVALS = 2


def normalised(text: Column) -> Column:
    """A text with each run of white space as one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANK, " ")


class DigestIndex:
    """Digests of all texts that have arrived, and the id that stays for each: a table in a folder that outlives the session.

    The number of buckets is fixed when the index is made and read from it afterwards; it should grow with the digests
    that are expected, some million a bucket. There is one writer at a time. An arrival that is repeated after a failure
    adds nothing twice, since what has got in is no longer new.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            self.buckets = spark.read.parquet(f"{self.path}/settings").first()["buckets"]
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(f"{self.path}/settings")
        self.name = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()}"
        where = f"{self.path}/digests".replace("'", r"\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, keep_row BIGINT, arrival STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{where}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, firsts: DataFrame) -> DataFrame:
        """Rows of `firsts` (digest, ...; one a digest) whose digest isn't in the index: a sort-merge anti-join, whose side
        of the index is read bucket by bucket and never shuffled."""
        return firsts.hint("merge").join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, digests: DataFrame, arrival: str) -> None:
        """Appends those of (digest, doc_id, row) that are new, each with its smallest id; ids before no id, then by row.

        Copies are counted out before the shuffle, so a text that is most of an arrival is a row a task."""
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
        new = self.unseen(digests.groupBy("digest").agg(first)).select("digest", "first.doc_id", "first.row", F.lit(arrival))
        new.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, row): one row a document; `row` tells rows apart, whatever they hold."""
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    return written(found, "digests")


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, arrivals: int = ARRIVALS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row: texts are equal when they are so after each run of
    white space has become one space, and of equal ones the row with the smallest id stays.

    The documents arrive in parts by id, smaller ids first; each part is held against the index by an anti-join and what
    is new is appended. With an `index` that has digests already, what is in it stays (`keep_id` is its id) and nothing
    equal is kept. group_size: rows among `docs` with an equal text.

    Null texts are empty texts, which are equal to each other; a text of blanks is one space. Rows without an id come
    behind those with one, and keep_id is null if no row has one. Of rows with the same id and text exactly one stays.
    No documents give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, scratch(spark, "digest-index"))
    found, arrival = digests(docs), uuid.uuid4().hex
    cuts = found.select(F.percentile_approx("doc_id", [k / arrivals for k in range(1, arrivals)]).alias("cuts")).first()["cuts"] if arrivals > 1 else []
    low = None
    for high in [*sorted(set(cuts or [])), None]:
        part = F.lit(True) if low is None else (F.col("doc_id") > low) | F.col("doc_id").isNull()
        part = part if high is None else part & (F.col("doc_id") <= high)
        index.add(found.where(part), arrival)
        low = high
    sizes = found.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    stays = index.table().where(F.col("arrival") != arrival).select("digest").withColumn("older", F.lit(True))
    several = sizes.join(stays, "digest", "left").where(F.coalesce("older", F.lit(False)) | (F.col("group_size") > 1)).drop("older")
    verdict = several.join(index.table(), "digest").select("digest", "group_size", "keep_id", (F.col("arrival") == arrival).alias("new"), "keep_row")
    out = with_values(found, written(verdict, "digest-groups"), ["digest"])
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("new") & (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
