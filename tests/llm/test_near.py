"""The near-duplicate stage against all pairs, on real and on hostile rows."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import near, queries
from tests.compare import DATA
from tests.llm.test_operators import hostile


def whole_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """Of all pairs with a Jaccard similarity of 0.8 or more, the components; the first row of each by id stays."""
    sets = [whole_set(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or 9 * both >= 4 * (len(sets[a]) + len(sets[b])) > 0:
            parent[root(a)] = root(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(rows[k]["doc_id"])
    return sorted(min((i is None, i or 0) for i in g) for g in groups.values())


def chains(spark):
    """Texts that are a few words apart one after the other, in one large bucket, and some beside it."""
    words, rows = [f"w{k}" for k in range(120)], []
    for k in range(40):
        words[3 * k] = f"x{k}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join([f"y{k}-{j}" for j in range(10)] + words[:60])) for k in range(6)]
    return spark.createDataFrame([*rows, (7, "another text under the id of seven"), (7, "another text under the id of seven")], "doc_id bigint, text string")


@pytest.mark.parametrize("block", [near.BLOCK, 2])
@pytest.mark.parametrize("which", ["hostile", "sf", "chains"])
def test_near_dedup_against_all_pairs(spark, which, block):
    docs = {"hostile": hostile, "chains": chains, "sf": lambda s: queries.table(s, str(DATA / "sf0.01"), "documents").where("n_chars < 3000 and doc_id < 600")}[which](spark)
    got = near.keep_one(docs, block)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == brute(docs.select("doc_id", "text").collect())


def test_stage_catches_what_fingerprints_miss(spark):
    """Texts 205 and 774 of sf0.1: a similarity of 0.836, with fingerprints 11 bits apart."""
    docs = queries.table(spark, str(DATA / "sf0.1"), "documents").where(F.col("doc_id").isin(205, 774))
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [205]


def test_wide_sketches_never_discard_a_link():
    """Sketches differ in as many bits as sets in shingles at most, whatever their lengths; unlike sets differ in many."""
    rng = np.random.default_rng(7)
    for n, m, common in ((2000, 2000, 1900), (4097, 4000, 3800), (5000, 9000, 4000), (600, 700, 0)):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        y = np.concatenate([x[:common], rng.integers(0, 1 << 63, m - common, dtype=np.uint64)])
        apart = near.parted(near.wide_sketch(x), near.wide_sketch(y))
        assert apart <= n + m - 2 * common
        assert apart > (n + m) / 9 or common >= 0.8 * min(n, m)
    assert near.wide_sketch(x[:512]) is None


def test_map_columns_repeated_rows_and_the_session(spark):
    """Rows are told apart by their maps too, of rows alike to the last column one stays, and the session's batches are as before."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(1, "one two three four five six", {"a": 1}), (1, "one two three four five six", {"a": 2}), *[(2, "seven eight", {"b": 3})] * 50, (3, "nine", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, more map<string, int>").repartition(7)
    got = near.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 3]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_empty_table(spark):
    assert near.keep_one(hostile(spark).limit(0)).count() == 0


def test_simhash_links_come_first_and_prefixes_find_the_rest(spark, monkeypatch):
    """Near copies whose fingerprints are a few bits apart are found without prefixes, others by them; both are verified."""
    long = [f"w{k}" for k in range(400)]
    texts = {1: long, 2: [*long[:-1], "other"], 3: long[:330], 4: [f"v{k}" for k in range(400)]}
    prints = {k: near.simhash.majority(near.shingle_set(" ".join(x))) for k, x in texts.items()}
    assert (prints[1] ^ prints[2]).bit_count() <= near.PRINT_BITS < (prints[1] ^ prints[3]).bit_count()
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in texts.items()], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in near.keep_one(docs).collect()) == [1, 4]
    for name in ("star_pairs", "cross_pairs"):
        monkeypatch.setattr(near, name, lambda members, nodes, *more: nodes.select("node", "node").toDF("a", "b").limit(0))
    assert sorted(r["doc_id"] for r in near.keep_one(docs).collect()) == [1, 3, 4]
