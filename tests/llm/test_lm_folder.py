"""The language model's files on shared storage that isn't mounted, as one worker sees them that is used again."""

from __future__ import annotations

import shutil

import numpy as np
import pytest
from pyarrow.fs import LocalFileSystem

from tessera.llm import lm


@pytest.fixture
def built(spark, tmp_path, monkeypatch):
    """A model, its folder, and an address under which the folder can't be opened as a path."""
    near, far = tmp_path / "near", tmp_path / "far"
    about = lm.build(spark.createDataFrame([("a b a b c",)] * 300 + [("b c d",), (None,)], "text string"), f"file://{near}")
    far.mkdir()
    real, uri = lm.file_system, f"mem://{tmp_path.name}/far"
    monkeypatch.setattr(lm, "file_system", lambda x: (LocalFileSystem(), str(far)) if x == uri else real(x))
    return about, near, far, uri


def copy(near, far, *names):
    for name in names:
        for path in near.glob(f"{name}-*"):
            shutil.copy(path, far)


def test_folder_that_had_words_alone(built):
    about, near, far, uri = built
    copy(near, far, "words")
    words = lm.Sorted(lm.Folder(uri), "words", about["word_bits"], lm.I)
    assert words.first[-1] == about["words"] > 0
    copy(near, far, "pairs", "stats")
    found = lm.tokens([b"a b c", b"d a"])
    got, want = (lm.Model(about | {"uri": x}).log10(*found) for x in (uri, about["uri"]))
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert len(set(want[0].round(6))) > 2


@pytest.mark.parametrize("gone", ["words-*.key", "words-*.n", "pairs-*.key", "pairs-*.n", "pairs-*.often", "stats-*.n"])
def test_missing_file_is_an_error(built, gone):
    about, near, far, uri = built
    copy(near, far, "words", "pairs", "stats")
    max(far.glob(gone), key=lambda p: p.stat().st_size).unlink()
    with pytest.raises((FileNotFoundError, ValueError)):
        lm.Model(about | {"uri": uri}).log10(*lm.tokens([b"a b a b c", b"b c d", b""]))


def test_long_texts_part_by_part(spark, monkeypatch):
    """A text gives the same tokens and score whether it is read whole or in small parts, words longer than a part included."""
    texts = ["Aa b " * 40, "x" * 300 + " b\tc " + "y" * 90, "", " " * 200, "b" * 64, None, "é" * 70 + "\x0bd"]
    batch = lm.pa.RecordBatch.from_arrays([lm.pa.array(texts)], ["text"])
    whole = lm.tokens([(t or "").encode() for t in texts])[0]
    monkeypatch.setattr(lm, "SLAB", 16)
    parts = list(lm.lots(iter([batch]), 0))
    assert np.array_equal(np.concatenate([p.found for p in parts]), whole) and len(parts) > 20


def test_score_of_long_texts(spark):
    docs = spark.createDataFrame([(k, "a b c d e " * (400_000 if k == 3 else 3)) for k in range(8)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    assert rows[3]["n_tokens"] == 2_000_001 and rows[4]["n_tokens"] == 16
    a = {k: r["score"] for k, r in rows.items()}
    assert a[3] == pytest.approx((a[3] / 2_000_001) * 2_000_001) and a[3] < a[4] < 0
