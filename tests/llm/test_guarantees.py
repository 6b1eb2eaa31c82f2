"""What the operators promise: scores as plain loops give them, columns of any name, results that no partition changes,
measured recall, and work that isn't done."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import common, decontaminate, labelled, lines, near, packing, quality, queries, simhash, toxicity, warc
from tests.compare import DATA
from tests.llm.test_near import brute
from tests.llm.test_operators import folded, hostile, ids, labels

TINY, SMALL = str(DATA / "sf0.001"), str(DATA / "sf0.01")


# Classifiers by plain loops


def plain_quality(net, text):
    """The network's score with a loop over every window of every chunk."""
    data = text.encode() if text else b""
    if not data:
        return net.empty
    blocks = -(-len(data) // quality.BLOCK)
    raw = data + b"\0" * (blocks * quality.BLOCK + quality.WIDTH - quality.STEP - len(data))
    pooled = []
    for b in range(blocks):
        best = np.zeros(quality.FILTERS)
        for p in range(quality.POSITIONS):
            at = b * quality.BLOCK + p * quality.STEP
            x = np.concatenate([net.embedding[c] for c in raw[at : at + quality.WIDTH]])
            best = np.maximum(best, np.maximum(x @ net.filters + net.bias, 0))
        pooled.append(best)
    chunks = [np.maximum(a, b) for a, b in zip(pooled, pooled[1:], strict=False)] or pooled
    logits = [np.maximum(c @ net.hidden + net.hidden_bias, 0) @ net.out[:-1] + net.out[-1] for c in chunks]
    return 1 / (1 + np.exp(-(np.mean(logits) * net.combine[0] + np.min(logits) * net.combine[1] + net.combine[2])))


def test_quality_against_plain_loops(spark):
    docs, truth = queries.table(spark, TINY, "documents"), queries.table(spark, TINY, "labels")
    net = quality.trained(docs, truth)
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, net).collect()}
    some = [r for r in docs.where("doc_id < 40").collect()]
    for r in some:
        assert scores[r["doc_id"]] == pytest.approx(plain_quality(net, r["text"]), abs=1e-4)
    assert {r["doc_id"]: r["score"] for r in quality.classify_quality(docs.repartition(5), truth).collect()} == pytest.approx(scores, abs=1e-9)


def test_toxicity_against_plain_lengths(spark):
    docs, truth = queries.table(spark, SMALL, "documents"), queries.table(spark, SMALL, "labels")
    model = toxicity.trained(docs, truth)
    assert len(model.ordinary) > 1000 and len(model.toxic) > 200 and model.toxic not in model.ordinary
    size = lambda data, content: len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False).compress(data))
    for r in docs.where("doc_id < 30 and text <> ''").collect():
        data = r["text"].lower().encode()
        parts = [data[at : at + 64] for at in range(0, max(1, len(data) - 32), 32)]
        assert b"".join([parts[0], *(p[32:] for p in parts[1:])]) == data
        saved = [size(p, model.ordinary) - size(p, model.ordinary + model.toxic) for p in parts]
        top = sorted(saved)[-3:]
        want = [top[-1], np.mean(top), np.mean(saved), *(np.mean([s >= k for s in saved]) for k in (2, 3, 4)), *(np.log1p(sum(s >= k for s in saved)) for k in (3, 4, 5))]
        assert model.features(r["text"]) == pytest.approx(want)


def test_both_classes_train_their_own_dictionary():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmno"), 6))
    common_words, bad = [word() for _ in range(300)], ["zzrotten", "zzvile", "zzfilthy", "zzwretch"]
    text = lambda extra: " ".join(extra[k % len(extra)] if extra and k % 9 == 4 else common_words[rng.integers(300)] for k in range(80))
    texts = [text(bad) if k % 2 else text([]) for k in range(300)]
    model = toxicity.train(texts, np.array([float(k % 2) for k in range(300)]), np.ones(300))
    assert any(w[2:].encode() in model.toxic for w in bad) and not any(w.encode() in model.ordinary for w in bad)
    assert model.score(text(bad)) > 0.9 > 0.1 > model.score(text([]))


def test_sample_is_bounded_and_whole(spark):
    docs = spark.createDataFrame([(k, f"t{k} " * (1 if k % 7 else 5_000)) for k in range(200)] + [(5, "again")], "doc_id bigint, text string")
    truth = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id bigint, quality int")
    texts, y, weight = labelled.labelled_sample(docs, truth, "quality", 3, 1, 30, longest=1_000)
    assert len(texts) == len(y) == len(weight) <= 60 and all(len(t) < 1_000 for t in texts)
    assert set(texts) <= {r["text"] for r in docs.collect()}
    few, _, _ = labelled.labelled_sample(docs, truth, "quality", 3, 1, 30, most_chars=50)
    assert 0 < len(few) < 30 and few == labelled.labelled_sample(docs.repartition(9), truth, "quality", 3, 1, 30, most_chars=50)[0]
    assert labelled.labelled_sample(docs, truth.limit(0), "quality", 3, 1, 30)[0] == []


# Columns of any name


CLASH = ["score", "__score", "__first", "__kept", "__key", "key", "row", "kept", "place", "repeats", "n_lines", "n_dropped", "site", "lines", "b_doc_id", "b_text_key"]


def test_columns_of_any_name_stay_as_they_are(spark):
    base = hostile(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs = base.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH))
    truth, bench = labels(spark), spark.createDataFrame([(1, "Two words")], "item_id bigint, text string")
    for stage in (lambda d: quality.keep_quality(d, truth, least=0.0), lines.without_boilerplate, near.keep_one, lambda d: decontaminate.decontaminate(d, bench)):
        got = stage(docs)
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASH)
        assert Counter(r["text"] for r in rows) == Counter(r["text"] for r in stage(base).collect())


# Partitions, recall, work


def test_packing_does_not_depend_on_partitions(spark):
    docs = queries.table(spark, TINY, "documents").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.limit(3))
    one, other = (Counter(map(tuple, packing.pack(d, queries.TOKENIZER, group_pieces=40).collect())) for d in (docs, docs.repartition(13)))
    assert one == other and len({r[5] >> 32 for r in one}) > 3


def test_equal_pieces_go_to_many_groups(spark):
    docs = spark.range(3_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("the same text").alias("text"))
    rows = packing.pack(docs, queries.TOKENIZER, group_pieces=100).collect()
    assert len(rows) == 3_000 and len({r["sequence_id"] >> 32 for r in rows}) > 20


def test_containment_recall_by_size_range(spark):
    """Items that documents contain in just 0.8 of their shingles or a little more, for every range of sizes."""
    rng = np.random.default_rng(8)
    items, docs, want = [], [], set()
    for k, size in enumerate([5, 6, 12, 20, 30, 40, 60, 90, 130, 200, 400, 700, 1200] * 6):
        words = [f"i{k}w{j}" for j in range(size)]
        items.append((k, " ".join(words)))
        shingles = max(1, size - 4)
        keep = size - int(0.19 * shingles) if size > 8 else size
        noise = [f"n{rng.integers(1 << 30)}" for _ in range(400)]
        docs.append((k, " ".join([*noise[:200], *words[:keep], *noise[200:]])))
        want.add((k, k))
    found = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == want
    parts = {r["part"] for r in decontaminate.item_table(spark.createDataFrame(items, "item_id bigint, text string")).select("part").distinct().collect()}
    assert len(parts) == 6 and len({decontaminate.hits_needed(n) for _, n in decontaminate.RANGES if n}) == 5


def test_archive_query_reads_no_block_it_does_not_need(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(k, f"u{k}", f"page {k % 4}" * 50) for k in range(40)], "page_id bigint, url string, html string")
    path = warc.archive(pages, str(tmp_path / "w"))
    plan = warc.read_archive(spark, path).where("warc_type = 'response'")
    assert plan.count() == 4 and warc.read_pages(spark, path).count() == 40
    read = []

    class Counted(warc.WarcReader):
        pass

    real = warc.batch
    monkeypatch.setattr(warc, "batch", lambda rows: (read.extend(rows), real(rows))[1])
    reader = Counted({"path": path})
    assert list(reader.pushFilters([warc.EqualTo(("warc_type",), "response")])) == []
    for part in reader.partitions():
        list(reader.read(part))
    assert len(read) == 4 and all(r[-1] for r in read)


def test_join_that_no_key_skews(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else None if k % 2 else f"k{k}") for k in range(3_000)], "id bigint, key string")
    values = spark.createDataFrame([("hot", 1), ("k0", 2), ("none", 3)], "key string, value int")
    plain = Counter(map(tuple, rows.join(values, ["key"], "left").select("id", "key", "value").collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    got = common.with_values(rows, values, ["key"], together=100)
    assert Counter(map(tuple, got.select("id", "key", "value").collect())) == plain


def test_shared_folder_is_required_on_a_cluster(spark):
    class Cluster:
        conf, sparkContext = type("C", (), {"get": lambda self, *a: None})(), type("S", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        common.shared_dir(Cluster())


# The pipeline against a plain version of all of its stages


def plain_pipeline(spark):
    docs, truth = queries.table(spark, TINY, "documents"), queries.table(spark, TINY, "labels")
    net = quality.trained(docs, truth)
    rows = [r.asDict() for r in docs.collect() if net.score(r["text"]) >= 0.5]
    norm = lambda x: x.strip(common.BLANK_CHARS)
    pages, has = Counter(r["source"] for r in rows), defaultdict(Counter)
    for r in rows:
        has[r["source"]].update({norm(x) for x in (r["text"] or "").split("\n")} - {""})
    often = {s: {x for x, n in c.items() if n >= lines.PAGES and n > lines.RATIO * pages[s]} for s, c in has.items()}
    for r in rows:
        if r["text"] is not None:
            r["text"] = "\n".join(x for x in r["text"].split("\n") if norm(x) not in often[r["source"]])
    kept = {i for none, i in brute(rows) if not none}
    rows = [r for r in rows if r["doc_id"] in kept]
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [folded(t)] for k in range(max(1, len(w) - 4)) if w}
    items = [shingles(r["text"]) for r in queries.table(spark, TINY, "benchmark").collect()]
    clean = [r for r in rows if not any(s and len(s & shingles(r["text"])) >= np.ceil(0.8 * len(s) - 1e-9) for s in items)]
    tokenizer, want = Tokenizer.from_file(queries.TOKENIZER), Counter()
    for r in clean:
        own = ids(tokenizer, r["text"])
        want.update((r["doc_id"], at, min(4096, len(own) - at), zlib.crc32(np.array(own[at : at + 4096], "<u4").tobytes()), len(own)) for at in range(0, len(own), 4096))
    return want


def test_pipeline_against_plain_stages(spark):
    rows = corpus_pipeline.run(spark, TINY).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == plain_pipeline(spark)
    spans = defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in s) <= 4096 and sorted(s)[0][0] == 0 for s in spans.values())


def test_fingerprints_against_pivots_discard_no_link():
    """No two fingerprints within three bits differ by more in their distance to any pivot."""
    rng, p = np.random.default_rng(6), [int(np.int64(x).view(np.uint64)) for x in simhash.pivots(16)]
    table = lambda x: [bin(x ^ q).count("1") for q in p]
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63, dtype=np.int64))
        for bits in combinations(rng.choice(64, 4, replace=False).tolist(), 3):
            y = x ^ sum(1 << int(b) for b in bits)
            assert max(abs(a - b) for a, b in zip(table(x), table(y), strict=True)) <= 3
