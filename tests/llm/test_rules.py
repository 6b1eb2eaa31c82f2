"""Line rules: what goes from a document that stays."""

from __future__ import annotations

import pytest

from tessera.llm import rules
from tests.compare import DATA

PROSE = "\n".join(["The fox went down to the river before noon, and nobody asked it why.", "A judge, who had lost his way, slept under the old bridge.", "Miller and child sold apples at the market; there were few buyers that day.", "When evening came they counted what was left and walked home."])
GONE = [
    "buy now " * 40, "win win win win win win win win win win win win, win.", "Home | About | Contact", "Accueil  »  Recherche", "Startseite", "Inicio | Buscar | Más",
    "© 2020, All rights reserved.", "Tous droits réservés.", "Alle Rechte vorbehalten.", "Todos los derechos reservados.", "##### ===== #####", "https://a.example/x www.b.example/y see",
    "cheap pills here cheap watches there best price now order today fast free delivery world wide",
]
STAYS = ["A title without a full stop", "He said that the cookie was good, and that the whole town, which had never seen one before, stood in line from the morning to the evening to get one more of them.", "Nächste Woche.", "1. first item", "It cost $5."]


@pytest.mark.parametrize("line", GONE)
def test_line_goes_and_document_stays(spark, line):
    row = rules.judge(spark.createDataFrame([(1, PROSE + "\n" + line[:150] + "\n" + PROSE)], "doc_id bigint, text string")).first()
    assert row["cleaned"] == PROSE + "\n" + PROSE
    assert rules.judge(spark.createDataFrame([(1, PROSE + "\n" + line[:60])], "doc_id bigint, text string")).first()["kept"]


@pytest.mark.parametrize("line", STAYS)
def test_line_stays(spark, line):
    assert rules.judge(spark.createDataFrame([(1, line)], "doc_id bigint, text string")).first()["cleaned"] == line


def test_repetitive_line_goes_and_document_is_kept(spark):
    text = PROSE + "\n" + " ".join(["spam", "eggs"][k % 5 % 2] for k in range(13)) + "."
    row = rules.judge(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row["kept"] and "spam" not in row["cleaned"] and not row["base_failed"]


def test_good_documents_are_kept_in_every_language(spark):
    docs, labels = (spark.read.parquet(str(DATA / f"sf0.01/{t}.parquet")) for t in ("documents", "labels"))
    good = rules.judge(docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id")).where("not base_failed").join(docs.select("doc_id", "lang"), "doc_id")
    for r in good.groupBy("lang").agg({"kept": "count"}).withColumnRenamed("count(kept)", "n").join(good.where("kept").groupBy("lang").count(), "lang").collect():
        assert r["count"] >= 0.98 * r["n"], r


WHOLE = {
    "hard-wrapped": "The old harbour of the town had been closed for so many years that hardly\nanybody who lived there could still remember the last of the great ships which\nhad once brought the wool and the wine that had made the merchants of the place\nrich and the council proud.",
    "hard-wrapped, capitals": "Der alte Hafen der Stadt war seit so vielen Jahren geschlossen, dass kaum noch\njemand von denen, die dort wohnten, sich an das letzte der großen und stolzen\nSchiffe erinnern konnte, die einst die Wolle und den Wein gebracht hatten, mit\ndenen die Kaufleute reich geworden waren.",
    "recipe": "Heat the oven and line a tray with paper.\nRoll the cookie dough into small balls.\nPut every cookie on the tray, far from the next.\nLet each cookie cool before you serve it, and keep the rest in a closed tin for a week.",
    "law": "The copyright law of that year gave authors thirty years.\nA court held that javascript can be a work of its own.\nThe privacy policy of the ministry was debated for months in both of the chambers before the vote.\nNobody had asked the authors.",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_ordinary_prose_stays_whole(spark, name):
    row = rules.judge(spark.createDataFrame([(1, WHOLE[name])], "doc_id bigint, text string")).first()
    assert row["kept"] and row["cleaned"] == WHOLE[name]


def test_wrapped_words_without_a_sentence_go(spark):
    soup = "cheap pills here cheap watches there best price now order today fast free\ndelivery world wide cheap bags and shoes for all of the family order before noon\nand save on every item in the whole store for men and women"
    row = rules.judge(spark.createDataFrame([(1, WHOLE["hard-wrapped"] + "\n\n" + soup + "\n \n" + WHOLE["hard-wrapped"])], "doc_id bigint, text string")).first()
    assert row["cleaned"] == WHOLE["hard-wrapped"] + "\n\n \n" + WHOLE["hard-wrapped"]


@pytest.mark.parametrize("line", ["This site uses cookies to improve your experience.", "Copyright (c) 1999-2004 by the authors", "© Example Ltd.", "Bitte JavaScript aktivieren, um diese Seite zu sehen."])
def test_notices_go(spark, line):
    assert rules.judge(spark.createDataFrame([(1, PROSE + "\n" + line)], "doc_id bigint, text string")).first()["cleaned"] == PROSE
