"""Readers of question files. Every reader has a schema; lists kept as text become arrays once, here."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.prepare import without_header_rows

QA = "question string, context string, answer string"


@F.pandas_udf(T.ArrayType(T.StringType()))
def literal_list(cells: pd.Series) -> pd.Series:
    """A printed list of strings as an array. Quotes of either kind may be mixed, which no JSON option reads. Cells
    that are no list give null."""

    def one(cell):
        if cell is None:
            return None
        for read in (json.loads, ast.literal_eval):
            try:
                found = read(cell)
            except (ValueError, SyntaxError):
                continue
            return [str(x) for x in found] if isinstance(found, (list, tuple)) else None
        return None

    return cells.map(one)


def read_csv(spark: SparkSession, path: str, schema: str = QA, sep: str = ",", lists: tuple[str, ...] = ("context",), header_of: str | None = None) -> DataFrame:
    """A CSV with a header and quoted cells that may span lines. An unnamed index column has a name in `schema` like any
    other. Rows that repeat the header go if `header_of` names a column to tell them by."""
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", True).csv(path)
    if header_of:
        rows = without_header_rows(rows, header_of)
    return rows.withColumns({c: literal_list(F.col(c)) for c in lists})


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str = "id bigint, question string, documents array<string>") -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): trimmed lines that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def as_questions(rows: DataFrame, source: str, question_id: Column, documents: str = "context", labels: str | None = None) -> DataFrame:
    """The one layout of questions: question_id, source, question, documents, answer, doc_labels."""
    have = rows.columns
    answer = F.col("answer") if "answer" in have else F.lit(None).cast("string")
    return rows.select(question_id.cast("bigint").alias("question_id"), F.lit(source).alias("source"), "question", F.col(documents).alias("documents"), answer.alias("answer"), (F.col(labels) if labels else F.lit(None).cast("array<string>")).alias("doc_labels"))


def items_of(questions: DataFrame) -> DataFrame:
    """(game_id, item_idx, text): a row for each document."""
    return questions.select(F.col("question_id").alias("game_id"), F.posexplode("documents").alias("item_idx", "text"))


def games_of(questions: DataFrame) -> DataFrame:
    """(game_id, query, n_items, gold); a question without documents is no game."""
    return questions.where(F.size("documents") > 0).select(F.col("question_id").alias("game_id"), F.col("question").alias("query"), F.size("documents").alias("n_items"), F.col("answer").alias("gold"))
