"""The training-data operators against brute force and on rows that are null, empty, long, tied or repeated."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import decontaminate, lines, lm, packing, quality, queries, rules, simhash, toxicity, warc, wrappers
from tessera.llm.components import components
from tests.compare import DATA, same

SF, TINY = str(DATA / "sf0.01"), str(DATA / "sf0.001")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp bigint, keys string"
LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(60_000))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hostile(spark):
    """Nulls, empty and long texts, copies, repeated rows and ids, and columns that clash with the operators' own."""
    texts = [None, "", " \n\t", "one", "Two words", LONG, LONG, "a b c d e f\nsame line\nsame line\n" * 3, "é ü x \x0b y", "a b c d e f\nsame line\nsame line\n" * 3]
    rows = [(k, t, None, None if k % 3 else "site", None, 0.5, 7, "k") for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id here at all", None, None, None, None, None, None), (4, "another text with id four", "en", "site", 3, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(12)] + [(None, 1, 1), (3, None, None), (5, 0, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int")


def folded(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# Classifiers


def roc(score, y):
    order = np.argsort(np.argsort(score))
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("query, label, least", [(queries.op1_quality, "quality", 0.85), (queries.op9_toxicity, "toxic", 0.9)])
def test_classifiers_on_held_out_rows(spark, query, label, least):
    scored = query(spark, SF)
    truth = queries.table(spark, SF, "labels").select("doc_id", label)
    rows = scored.where("held_out").join(truth, "doc_id").collect()
    score, y = np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])
    assert len(rows) > 50 and roc(score, y) > least
    assert scored.count() == queries.table(spark, SF, "documents").count()


@pytest.mark.parametrize("classify, cut", [(quality.classify_quality, 0.5), (toxicity.classify_toxicity, 0.3)])
def test_classifiers_on_hostile_rows(spark, classify, cut):
    docs = hostile(spark)
    rows = classify(docs, labels(spark)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) and r["held_out"] is not None
    assert classify(docs.limit(0), labels(spark)).count() == 0
    assert classify(docs, labels(spark).limit(0)).count() == docs.count()


def test_quality_covers_the_whole_text():
    net = quality.train(["good plain words here " * 9, "x#$ zz@@ !!" * 20] * 8, np.array([1.0, 0.0] * 8), np.ones(16))
    long = "good plain words here " * 9_000
    assert net.blocks(long.encode()).shape[0] == -(-len(long) // quality.BLOCK)
    slabs = net.blocks(long.encode())
    whole = np.concatenate([slabs[:1], slabs[1:]])
    assert np.allclose(slabs, whole) and abs(net.score(long) - net.score(long + "x#$ zz@@ !!" * 9_000)) > 1e-6


# Extraction


def test_wrapper_keeps_the_article():
    page = lambda k: f"<html><head><title>t{k}</title><script>var x={k};</script></head><body><nav><a href=#>Home</a></nav><div class='main'><article><h1>Story {k}</h1>" + "".join(f"<p>Para {k}.{j} &amp; more\n  text</p>" for j in range(1 + k % 4)) + f"</article></div><div class=sidebar>ads {k}</div><div id=comments><p>reader {k}</p></div><footer>All rights</footer></body></html>"
    got = wrappers.extract([page(k) for k in range(9)])
    for k, text in enumerate(got):
        assert text == "\n\n".join([f"Story {k}", *(f"Para {k}.{j} & more text" for j in range(1 + k % 4))])


def test_extraction_on_hostile_pages(spark):
    rows = [(1, None, None), (2, "http://h/a", ""), (3, "http://h/b", "<p"), (3, "http://h/b", "<p"), (None, "x", "<div><p>" + "word " * 50_000 + "</p></div>"), (5, "http://h/c", "plain text")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit("h"))
    got = wrappers.extract_pages(pages).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert max(r["n_chars"] for r in got) == len("word " * 50_000) - 1
    assert wrappers.extract_pages(pages.limit(0)).count() == 0


# Packing


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("which", ["hostile", "sf"])
def test_packing_round_trip(spark, which):
    docs = hostile(spark) if which == "hostile" else queries.table(spark, TINY, "documents")
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    rows = packing.pack(docs, queries.TOKENIZER).collect()
    want = Counter()
    for d in docs.collect():
        own = ids(tokenizer, d["text"])
        want.update((d["doc_id"], at, min(4096, len(own) - at), zlib.crc32(np.array(own[at : at + 4096], "<u4").tobytes()), len(own)) for at in range(0, len(own), 4096))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    if which == "sf":
        assert total / (4096 * len(sequences)) > 0.95


def test_closest_fill_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths, room = rng.integers(1, 40, 9).tolist(), int(rng.integers(1, 120))
        best = max(s for s in (sum(x for k, x in enumerate(lengths) if m >> k & 1) for m in range(1 << 9)) if s <= room)
        picked = packing.closest(dict(Counter(lengths)), room)
        assert sum(n * x for x, n in picked) == best and all(n <= lengths.count(x) for x, n in picked)


def test_word_cache_generations():
    known, tokenizer = packing.WordIds(queries.TOKENIZER, 50), Tokenizer.from_file(queries.TOKENIZER)
    for k in range(12):
        text = " ".join(f"Word{j % (20 + k)}, İnka{j}. x{j}y" for j in range(k, k + 30))
        assert known.of([text])[0] == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# Language model


def brute_lm(train, texts):
    """The same bigram model in dictionaries."""
    streams = [[*folded(t), None] for t in train]
    words, pair = Counter(w for s in streams for w in s), Counter((a, b) for s in streams for a, b in zip(["<s>", *s[:-1]], s, strict=True))
    preds, after, follow = Counter(b for _, b in pair), Counter(), defaultdict(Counter)
    for (a, _), n in pair.items():
        after[a] += n
        follow[a][min(n, 3)] += 1
    level = lambda c: lm.discounts(*(sum(v == k for v in c.values()) for k in (1, 2, 3, 4)))
    dp, dw, total, size, tokens = level(pair), level(preds), len(pair), len(words), sum(words.values())
    rest = sum(dw[min(v, 3)] for v in preds.values()) / total
    out = []
    for t in texts:
        score = base = 0.0
        before = "<s>"
        for w in [*folded(t), None]:
            lower = max(preds[w] - dw[min(preds[w], 3)], 0) / total + rest / (size + 1)
            n = pair[before, w]
            free = sum(dp[k] * follow[before][k] for k in (1, 2, 3)) / after[before] if after[before] else 1.0
            score += math.log10((max(n - dp[min(n, 3)], 0) / after[before] if after[before] else 0) + free * lower)
            base += math.log10((words[w] + 1) / (tokens + size + 1))
            before = w
        out.append((len(folded(t)) + 1, base, score))
    return out


def test_language_model_against_dictionaries(spark):
    docs = queries.table(spark, TINY, "documents").unionByName(hostile(spark).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is null or doc_id not in (4)").withColumn("doc_id", F.col("doc_id") + 10_000))
    rows = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    data = [(d["doc_id"], d["text"]) for d in docs.collect()]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    want = brute_lm([t for i, t in data if not held(i)], [t for _, t in data])
    for (i, _), (n, base, score) in zip(data, want, strict=True):
        got = rows[i]
        assert got["held_out"] == held(i) and got["n_tokens"] == n
        assert got["base_score"] == pytest.approx(base, rel=1e-9) and got["score"] == pytest.approx(score, rel=1e-5, abs=1e-4)
    unseen = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_language_model_of_nothing(spark):
    docs = hostile(spark)
    assert lm.score_documents(docs.limit(0)).count() == 0
    assert {r["score"] for r in lm.score_documents(docs.where("doc_id is null")).collect()} == {0.0}


# Near-duplicates


def brute_print(text):
    words = folded(text)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most=3):
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= most:
                parent[root(a)] = root(b)
    return [root(k) for k in range(len(prints))]


def held_against(rows, ids, prints):
    group = brute_components(prints)
    least = {}
    for i, g in zip(ids, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = Counter((i, f"{p:016x}", least.get(g)) for i, p, g in zip(ids, prints, group, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == want


@pytest.mark.parametrize("paired", [simhash.PAIRED, 1])
@pytest.mark.parametrize("which", ["hostile", "sf"])
def test_simhash_against_all_pairs(spark, which, paired):
    docs = hostile(spark) if which == "hostile" else queries.table(spark, TINY, "documents")
    data = docs.select("doc_id", "text").collect()
    held_against(simhash.near_duplicates(docs, paired=paired).collect(), [d["doc_id"] for d in data], [brute_print(d["text"]) for d in data])


@pytest.mark.parametrize("paired", [simhash.PAIRED, 2])
def test_links_of_near_fingerprints(spark, paired):
    """Chains of fingerprints a few bits apart, in both ways of finding links."""
    rng = np.random.default_rng(5)
    prints = []
    for _ in range(12):
        p = int(rng.integers(0, 1 << 63, dtype=np.int64))
        for _ in range(6):
            prints.append(p)
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                p ^= 1 << int(b)
    prints = list(dict.fromkeys(prints))
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    nodes = spark.createDataFrame(list(enumerate(signed)), "rep bigint, fp bigint")
    got = {r["node"]: r["component"] for r in components(simhash.links(nodes, paired=paired)).collect()}
    group = brute_components(prints)
    least = {}
    for k, g in enumerate(group):
        least[g] = min(least.get(g, k), k)
    assert [got.get(k, k) for k in range(len(prints))] == [least[g] for g in group]


# Archives


@pytest.mark.parametrize("path", [TINY])
def test_warc_against_sql(spark, path):
    same(queries.op6_warc(spark, path), queries.WARC_SQL, path)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é\r\n\r\nWARC/1.1</p>"), (2, None, None), (3, "http://a/3\r\nX: y", "<p>é\r\n\r\nWARC/1.1</p>"), (4, "u", ""), (None, "u", "z"), (5, "http://b/5", "long " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("size", F.lit("x")).withColumn("sha", F.lit(1))
    path = warc.archive(pages, str(tmp_path / "w"))
    read = warc.read_archive(spark, path)
    assert {r["record_id"]: bytes(r["payload"]).decode() for r in read.where("warc_type = 'response'").collect()} == {"<urn:page:3>": rows[0][2], "<urn:page:4>": "", "<urn:page:5>": "long " * 200_000} | {r["record_id"]: "z" for r in read.where("record_id is null or record_id not like '<urn:page%'").collect()}
    assert warc.archived_pages(read).where("page_id = 1").first()["refers_to"] == 3
    assert read.where(F.col("target_uri").startswith("http://a/")).count() == 2
    assert [r["payload"] for r in warc.read_archive(spark, path, payload=False).where("warc_type = 'response'").collect()] == [None] * 4
    assert warc.archived_pages(warc.read_archive(spark, warc.archive(pages.limit(0), str(tmp_path / "none")))).count() == 0


def test_unfinished_archives_are_not_read(spark, tmp_path):
    """What a write in progress or a failed one has left beside the archives."""
    pages = spark.createDataFrame([(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two</p>")], "page_id bigint, url string, html string")
    path = tmp_path / "_w"
    warc.archive(pages, str(path))
    (path / "_temporary_warc").mkdir()
    first = next(p for p in path.iterdir() if p.name.endswith(".warc"))
    (path / "_temporary_warc" / "x.warc").write_bytes(first.read_bytes())
    (path / ".y.warc").write_bytes(first.read_bytes())
    assert warc.read_archive(spark, str(path)).where("warc_type = 'response'").count() == 2


def test_warc_filters_are_pushed_down():
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    reader = warc.WarcReader({"path": "/x"})
    rest = list(reader.pushFilters([EqualTo(("warc_type",), "response"), StringStartsWith(("target_uri",), "http://a"), GreaterThan(("content_length",), 4)]))
    assert len(rest) == 1 and len(reader.filters) == 2
    assert warc.wanted({"warc-type": "response", "warc-target-uri": "http://a/x"}, reader.filters)
    assert not warc.wanted({"warc-type": "response"}, reader.filters)


# Lines, rules, contamination


@pytest.mark.parametrize("name", ["op7_lines", "op8_rules", "op10_decontaminate"])
def test_against_sql(spark, name):
    same(queries.QUERIES[name](spark, TINY), queries.ORACLE[name], TINY)


def test_line_dedup(spark):
    rows = [(k, f"Menu \nown line {k}\n\nMenu", "s") for k in range(50)] + [(99, None, None), (98, "", None), (97, "Menu", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("lines", F.lit(0)).withColumn("n_lines", F.lit(0)).withColumn("row", F.lit(1)).withColumn("site", F.lit("z"))
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert got[0]["text"] == "own line 0\n" and got[0]["n_dropped"] == 2 and got[0]["n_lines"] == 4
    assert got[99]["text"] is None and got[98]["text"] == "" and got[97]["text"] == "Menu"
    assert lines.without_boilerplate(hostile(spark)).columns == hostile(spark).columns
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_rules_on_hostile_rows(spark):
    docs = hostile(spark)
    rows = rules.judge(docs).collect()
    assert len(rows) == docs.count()
    long = next(r for r in rows if r["n_words"] == 60_000)
    own = LONG.split(" ")
    each = [tuple(own[k : k + 8]) for k in range(len(own) - 7)]
    windows = Counter(each)
    inside = {k + j for k, w in enumerate(each) if windows[w] > 1 for j in range(8)}
    assert long["n_repeat_words"] == len(inside)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] == 0)
    assert rules.judge(docs.limit(0)).count() == 0


def test_rules_are_native(spark):
    plan = rules.judge(hostile(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_containment(spark):
    item = " ".join(f"q{k}" for k in range(40))
    items = spark.createDataFrame([(1, item), (1, item), (2, "short item"), (None, "three little words"), (4, None), (5, "")], "item_id bigint, text string")
    noise = " ".join(f"n{k}" for k in range(5_000))
    texts = [f"{noise} {item.upper()} {noise}", noise, None, "", "short item", "a short item here", " ".join(item.split()[:34]), " ".join(item.split()[:30]), "Three  little\nwords"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, item, "y"), (0, texts[0], "z")], "doc_id bigint, text string, item string").withColumn("n", F.lit(1)).withColumn("key", F.lit(1))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(docs, items).collect()}
    assert found == {(0, 1), (4, 2), (6, 1), (8, None), (None, 1)}
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {1, 2, 3, 5, 7}
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == docs.count()


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 300)] + [(7, 7), (500, 501), (501, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[k] for k in range(1, 41)} == {0} and {got[k] for k in range(101, 400)} == {100} and got[501] == 500 and 0 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
