"""Tables of results: utilities that are computed once, metrics that runs add to, and the forms results leave in."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.exact import finite
from tessera.operators.providers import KEY, Provider, evaluate

UTILITIES = "game_id bigint, provider string, n_items int, mask bigint, value double, mode string"
METRICS = "qid bigint, metric string, method string, budget int, k int, value double"


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at `path`, empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def load_utilities(spark: SparkSession, path: str) -> DataFrame:
    """One row a key. A run that was repeated may have left more: a finite value counts before one that isn't, and two
    finite values that differ are an error when they are read."""
    rows = load(spark, path, UTILITIES)
    good = finite(F.col("value"))
    agreed = F.when(F.max(good) > F.min(good), F.raise_error(F.lit("a utility has two finite values")).cast("double")).otherwise(F.coalesce(F.max(good), F.min("value")))
    return rows.groupBy(*KEY).agg(F.min("n_items").alias("n_items"), agreed.alias("value"))


def save_utilities(rows: DataFrame, path: str) -> None:
    """Adds rows whose key isn't there; a directory for each mode, which readers can skip."""
    known = load_utilities(rows.sparkSession, path)
    new = rows.dropDuplicates(KEY).join(known.select(*KEY), KEY, "left_anti")
    new.select("game_id", "provider", "n_items", "mask", "value", "mode").write.partitionBy("mode").mode("append").parquet(path)


def evaluate_into(coalitions: DataFrame, path: str, provider: str, mode: str, score: Provider) -> DataFrame:
    """Scores what the table at `path` lacks, adds it, and returns the table."""
    spark = coalitions.sparkSession
    save_utilities(evaluate(coalitions, load_utilities(spark, path), provider, mode, score), path)
    return load_utilities(spark, path)


def pending(questions: DataFrame, done: DataFrame, key: str = "qid") -> DataFrame:
    """Questions without a row among the results."""
    return questions.join(done.select(key).distinct(), key, "left_anti")


def append_metrics(rows: DataFrame, path: str) -> int:
    """Adds the rows of questions that aren't there and returns how many questions the table has."""
    spark = rows.sparkSession
    pending(rows, load(spark, path, METRICS)).select("qid", "metric", "method", "budget", "k", "value").write.mode("append").parquet(path)
    return load(spark, path, METRICS).select("qid").distinct().count()


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


RESULTS = "qid bigint, method string, item_idx int, phi double"
EXTRAS = "qid bigint, method string, name string, value string"


def save_results(path: str, results: DataFrame | None = None, extras: DataFrame | None = None) -> None:
    """Adds attributions (RESULTS) and whatever else a run has to tell (EXTRAS, values as JSON) to the tables at `path`."""
    for name, rows, schema in (("results", results, RESULTS), ("extras", extras, EXTRAS)):
        if rows is not None:
            rows.select(*(c.split()[0] for c in schema.split(", "))).write.mode("append").parquet(f"{path}/{name}")


def load_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(attributions, extras) that runs have saved; a repeated run's rows count once."""
    return tuple(load(spark, f"{path}/{name}", schema).distinct() for name, schema in (("results", RESULTS), ("extras", EXTRAS)))


def summary_json(intervals: DataFrame) -> DataFrame:
    """(metric, json): {"method@budget": [mean, low, high, n]} from rows of bootstrap_ci(); methods without a budget have
    their name alone. A metric's methods and budgets are its group."""
    key = F.concat_ws("@", "method", F.col("budget").cast("string"))
    cells = F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.alias("k"), F.array("point", "low", "high", F.col("n").cast("double")).alias("v")))))
    return intervals.groupBy("metric").agg(F.to_json(cells).alias("json"))


def latex_rows(report: DataFrame, digits: int = 3) -> DataFrame:
    """(metric, budget, method, line): a table line from paired_report(): difference, interval, p, wins, ties, losses."""
    f = f"%.{digits}f"
    line = F.format_string(rf"%s & {f} [{f}, {f}] & %s & %d/%d/%d \\", F.regexp_replace("method", r"([&%$#_{}])", r"\\$1"), F.coalesce("point", F.lit(float("nan"))), F.coalesce("low", F.lit(float("nan"))), F.coalesce("high", F.lit(float("nan"))), F.when(F.col("p_holm").isNull(), "--").otherwise(F.format_string(f, "p_holm")), "wins", "ties", "losses")
    return report.select("metric", "budget", "method", line.alias("line"))


def latex_table(report: DataFrame, caption: str) -> str:
    """A table of the report's lines, one for each metric, budget and method."""
    lines = latex_rows(report).orderBy("metric", "budget", "method").collect()
    body = "\n".join(f"{r['metric']} & {'--' if r['budget'] is None else r['budget']} & {r['line']}" for r in lines)
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}", r"\begin{tabular}{llllll}", r"metric & budget & method & difference & $p_{Holm}$ & W/T/L \\ \hline", body, r"\end{tabular}", r"\end{table}"])


def report_lines(report: DataFrame) -> DataFrame:
    """(metric, budget, method, line): a line for a console and a file from paired_report()."""
    number = F.format_string("%+.4f [%+.4f, %+.4f]", "point", "low", "high")
    head = F.concat_ws(" ", "metric", F.col("budget").cast("string"), "method")
    return report.select("metric", "budget", "method", F.concat(head, F.lit(": "), number, F.format_string(" W/T/L %d/%d/%d", "wins", "ties", "losses")).alias("line"))


def text_report(report: DataFrame) -> list[str]:
    """The lines in order: one for each method and budget of a metric, a bounded number."""
    return [r["line"] for r in report_lines(report).orderBy("metric", "budget", "method").collect()]
