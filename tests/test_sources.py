"""Readers, tables of results, preparation and text on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import prepare, providers
from tessera.operators.coalitions import powerset
from tessera.sources import questions, tables



def test_csv(spark, tmp_path):
    path = tmp_path / "qa.csv"
    path.write_text('question,context,answer,len_gt\n"Who?","[""it\'s"", \'b, c\']",x,2\nquestion,context,answer,len_gt\n"Line\ntwo","[""p"", ""q""]",,3\nbad,not a list,y,1\n')
    rows = questions.read_csv(spark, str(path), "question string, context string, answer string, len_gt string", header_of="len_gt").collect()
    assert [(r["question"], r["context"], r["answer"]) for r in rows] == [("Who?", ["it's", "b, c"], "x"), ("Line\ntwo", ["p", "q"], None), ("bad", None, "y")]


def test_other_formats(spark, tmp_path):
    (tmp_path / "semi.csv").write_text('question;context;answer\nq;"[""a""]";z\n')
    assert questions.read_csv(spark, str(tmp_path / "semi.csv"), sep=";").first()["context"] == ["a"]
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "question": "q", "documents": ["d", "e"]}, {"id": 2, "question": "r", "documents": []}]))
    found = questions.as_questions(questions.read_json_array(spark, str(tmp_path / "a.json")), "made", F.col("id"), "documents")
    assert questions.items_of(found).count() == 2 and questions.games_of(found).collect()[0]["n_items"] == 2 and questions.games_of(found).count() == 1
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert questions.read_json_lines(spark, str(tmp_path / "l.jsonl"), "a int").count() == 2
    (tmp_path / "t.txt").write_text(" True \n\nFalse\n")
    assert [r["line"] for r in questions.read_lines(spark, str(tmp_path / "t.txt")).collect()] == ["True", "False"]


def test_utilities_are_computed_once(spark, tmp_path):
    path, asked = str(tmp_path / "u"), []
    sizes = spark.createDataFrame([(0, 3)], "game_id bigint, n_items int")

    def score(rows):
        asked.append(rows.count())
        return providers.from_expression(F.bit_count("mask") * 1.0)(rows)

    first = tables.evaluate_into(powerset(sizes).where("mask < 3"), path, "p", "raw", score)
    assert first.count() == 3
    both = tables.evaluate_into(powerset(sizes), path, "p", "raw", score)
    assert both.count() == 8 and asked == [3, 5]
    assert tables.evaluate_into(powerset(sizes), path, "other", "raw", providers.from_batches(lambda f: f["mask"] * 2)).count() == 16


def test_metrics_resume(spark, tmp_path):
    rows = spark.createDataFrame([(1, "m", "x", None, None, 0.5), (2, "m", "x", None, None, 0.7)], tables.METRICS)
    assert tables.append_metrics(rows.where("qid = 1"), str(tmp_path / "m")) == 1
    assert tables.append_metrics(rows, str(tmp_path / "m")) == 2
    assert tables.load(spark, str(tmp_path / "m"), tables.METRICS).count() == 2


def test_reports(spark):
    from tessera.operators import stats

    rows = [(q, "m", k, 32, float(q * (k == "x") + q % 3)) for q in range(8) for k in ("x", "y_1")]
    metric = spark.createDataFrame(rows, "qid bigint, metric string, method string, budget int, value double")
    report = stats.paired_report(metric, "x", times=100)
    assert r"y\_1 &" in tables.latex_table(report, "c") and "W/T/L 7/1/0" in tables.text_report(report)[0]
    assert set(json.loads(tables.summary_json(stats.bootstrap_ci(metric, ["metric", "method", "budget"], times=100)).first()["json"])) == {"x@32", "y_1@32"}


@pytest.mark.parametrize("a, b, want", [("the", "an", 1.0), ("the", "cat", 0.0), ("A cat, sat!", "cat sat sat", 0.8), ("dog", "cat", 0.0), (None, None, 1.0)])
def test_token_f1(spark, a, b, want):
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    assert rows.select(text.token_f1(F.col("a"), F.col("b")).alias("f")).first()["f"] == pytest.approx(want)


def test_preparation(spark):
    row = spark.createDataFrame([(["a", "b", "c"],)], "d array<string>")
    get = lambda c: row.select(c.alias("x")).first()["x"]
    assert get(prepare.gold_first(F.col("d"), F.array(F.lit(2), F.lit(0)))) == ["a", "c", "b"]
    assert get(prepare.with_duplicate(F.col("d"), 1, 2)) == ["a", "b", "b", "c"]
    assert get(prepare.with_duplicate(F.col("d"), 7)) == ["a", "b", "c"]
    assert get(prepare.ablated(F.col("d"), F.lit(5).cast("bigint"))) == "a\n\nc"
    assert get(prepare.gold_of_type(F.lit("3hop"))) == [0, 1, 2]
    paragraphs = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(s).alias("is_supporting")) for t, s in (("p", False), ("g", True), ("g", False))))
    assert get(prepare.supporting_first(paragraphs)) == ["g", "p"]
    context = spark.createDataFrame([([("t", ["a", "b"]), ("u", ["c"])], [("u", 0), ("t", 1), ("t", 9)])], "context array<struct<title string, sents array<string>>>, supporting_facts array<struct<title string, sent_idx int>>")
    got = prepare.annotate_context(context).first()
    assert (got["gold_docs"], got["gold_sents"], got["documents"]) == ([0, 1], [1, 2], ["a b", "c"])


def test_lookup(spark):
    left = spark.createDataFrame([(" q ",), ("r",), ("s",)], "question string")
    right = spark.createDataFrame([("q", "1"), ("q ", "1"), ("r", "1"), ("r", "2")], "question string, answer string")
    assert {r["question"].strip(): (r["answer"], r["status"]) for r in prepare.lookup_answers(left, right, "question", "answer").collect()} == {"q": ("1", "found"), "r": (None, "conflict"), "s": (None, "missing")}
