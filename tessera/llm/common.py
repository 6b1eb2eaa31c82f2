"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows up to which a table may be broadcast; a row here is a few machine words, so this is some tens of MB.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share (`spark.checkpoint.dir`).

    Where a session on one machine (a local master, as in tests) has none, a local folder is set; a cluster without
    one is an error, as its machines would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: its lineage ends here and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def let_go(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.replace("file:///", "file:/").startswith(shared_dir(spark).replace("file:///", "file:/")):
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """`df` as a table in the shared folder that is bucketed by `keys`: joins on them don't shuffle it again."""
    spark = df.sparkSession
    path, n = scratch(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    label = path.rsplit("/", 1)[-1].replace("-", "_")
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).saveAsTable(label)
    return spark.table(label)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free(names: list[str], base: str) -> str:
    """A column name like `base` that none of `names` is, whatever their case."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base += "_"
    return base


def with_values(rows: DataFrame, values: DataFrame, on: list[str], together: int = 50_000) -> DataFrame:
    """`rows` with the columns of `values`, which has one row a key, or nulls: a left join that no frequent key skews.

    Few values are broadcast. Otherwise keys with more than `together` rows are dealt by a hash of the row, and their
    values are repeated for each part.
    """
    if values.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(values), on, "left")
    parts, part = free([*rows.columns, *values.columns], "parts"), free([*rows.columns, *values.columns], "part")
    many = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > together)
    many = small(written(many.select(*on, F.ceil(F.col("n") / together).alias(parts)), "frequent-keys"))
    several = F.coalesce(F.col(parts), F.lit(1))
    left = rows.join(many, on, "left").withColumn(part, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c, kind in rows.dtypes if not kind.startswith("map"))), several)).drop(parts)
    right = values.join(many, on, "left").withColumn(part, F.explode(F.sequence(F.lit(0).cast("bigint"), several - 1))).drop(parts)
    return left.join(right, [*on, part], "left").drop(part)


#: What operators keep in a Python worker from task to task, and how to let go of it.
KEPT: dict[str, Callable[[], None]] = {}


def take_turn(owner: str) -> None:
    """At the start of a task: a Python worker serves many operators in turn, so it lets go of what others have kept in it."""
    for name, clear in KEPT.items():
        if name != owner:
            clear()
    pa.default_memory_pool().release_unused()


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def fewer_rows(spark: SparkSession, rows: int = 500) -> str:
    """From now on fewer rows for each batch that goes to Python, where the session has Spark's own number: 10,000 texts at
    once take some hundred MB of an executor beside its heap, in the JVM and once more in the worker. Gives the number before."""
    before = spark.conf.get(BATCH_ROWS, "10000")
    if before == "10000":
        spark.conf.set(BATCH_ROWS, str(rows))
    return before


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """fewer_rows() for the jobs that run meanwhile."""
    before = fewer_rows(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def words(text: Column, fold: bool = True) -> Column:
    """Array of the words of a text; none for null. `fold`: A-Z in lower case."""
    text = F.coalesce(text, F.lit(""))
    text = F.translate(text, UPPER, LOWER) if fold else text
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by
