"""Vector codes, the digest index and the conversation tree against plain versions, and on hostile rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import exact, tries, vectors
from tessera.llm.common import scratch


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, label, np.floor(np.array(v, float) * scale).astype(np.int64)) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2].tolist()))[:entries]
    x = np.array([v for _, _, v in kept]).reshape(len(kept), parts, -1)
    books = np.array([v for _, _, v in first]).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()

    def assign():
        d = np.array([((x[:, p, None] - books[p][None]) ** 2).sum(-1) for p in range(parts)])
        return d.argmin(-1), d.min(-1)

    for _ in range(rounds):
        at, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (at[p] == e).any():
                    books[p, e] = [int(s) // int((at[p] == e).sum()) for s in x[:, p][at[p] == e].sum(0)]
    at, away = assign()
    error = away.sum(0)
    by = {}
    for (_, label, _), e in zip(kept, error, strict=True):
        by[label] = by.get(label, 0) + int(e)
    sha = hashlib.sha256(",".join(str(int(k)) for k in books.ravel()).encode()).hexdigest()
    return sorted([(i, "".join(f"{c:02x}" for c in at[:, k]), int(error[k]), by[label], sha) for k, (i, label, _) in enumerate(kept)], key=repr)


def some_vectors(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(0, 0.3, dim)], int(rng.integers(3)) if k % 7 else None) for k in range(n)]
    rows += [(1, rows[1][1], 2), (n + 1, None, 1), (n + 2, [None, *rows[0][1][1:]], 1), (n + 3, [float("nan"), *rows[0][1][1:]], 1), (n + 4, [float("-inf"), *rows[0][1][1:]], 0)]
    return [*rows, (None, rows[3][1], 1), *[(5000 + k, rows[3][1], 1) for k in range(40)]]


VECTOR = "vec_id bigint, embedding array<float>, label int"


def test_codes_equal_a_plain_version(spark):
    rows = some_vectors(150)
    docs = spark.createDataFrame([(*r, "x", {"a": 1}) for r in rows], f"{VECTOR}, code string, none map<string, int>").repartition(5)
    assert sorted((tuple(r) for r in vectors.compress(docs).collect()), key=repr) == plain_codes(rows)


def test_codes_of_few_vectors_and_of_none(spark):
    few = [(k, [0.1 * k] * 8, None) for k in range(3)]
    assert sorted((tuple(r) for r in vectors.compress(spark.createDataFrame(few, VECTOR)).collect()), key=repr) == plain_codes(few)
    assert vectors.compress(spark.createDataFrame([(1, None, 1)], VECTOR)).count() == 0
    with pytest.raises(ValueError):
        vectors.compress(spark.createDataFrame([(1, [0.5] * 9, 1)], VECTOR))


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(3)
    book, x = rng.integers(-900, 900, (16, 8)), rng.integers(-1000, 1000, (500, 8))
    book[5] = book[2]
    near = vectors.Approximation(book)
    lower, upper = near.bounds(x)
    away = ((x[:, None] - book[None]) ** 2).sum(-1)
    assert (lower <= away).all() and (away <= upper).all()
    best, least, refined = near.nearest(x)
    assert (best == away.argmin(1)).all() and (least == away.min(1)).all()
    assert refined < away.size / 2


def plain_exact(rows):
    import re

    out, groups = [], {}
    for k, (doc, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append((doc is None, doc or 0, k, doc))
    for text, members in groups.items():
        for n, (_, _, _, doc) in enumerate(sorted(members)):
            out.append((doc, min(members)[3], len(members), n == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


DOCS = [(5, "a  b"), (2, "a\tb"), (2, "a b"), (None, "a b"), (None, "z"), (None, "z"), (7, None), (9, ""), (8, " "), (10, "\n"), (11, "a b "), (3, "A b"), (12, "é" * 50_000), (13, "é" * 50_000)]


@pytest.mark.parametrize("arrivals", [1, 2, 5])
def test_exact_copies_equal_a_plain_version(spark, arrivals):
    rows = DOCS + [(100 + k, f"t{k % 30}") for k in range(300)]
    docs = spark.createDataFrame([(d, t, 1, {"a": 2}) for d, t in rows], "doc_id bigint, text string, digest int, row map<string, int>").repartition(4)
    assert sorted((tuple(r) for r in exact.deduplicate(docs, arrivals=arrivals).collect()), key=repr) == plain_exact(rows)
    assert exact.deduplicate(docs.limit(0)).count() == 0


def test_index_outlives_an_arrival_and_joins_without_a_shuffle_of_its_own(spark):
    path = scratch(spark, "index")
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "doc_id bigint, text string")
    exact.deduplicate(docs, exact.DigestIndex(spark, path, 4))
    spark.sql(f"DROP TABLE {exact.DigestIndex(spark, path).name}")  # another session has no such name; the files stay
    index = exact.DigestIndex(spark, path)
    assert index.buckets == 4
    later = exact.deduplicate(spark.createDataFrame([(0, "x"), (4, "w"), (5, "w")], "doc_id bigint, text string"), index)
    assert sorted((r["doc_id"], r["keep_id"], r["kept"], r["group_size"]) for r in later.collect()) == [(0, 1, False, 1), (4, 4, True, 2), (5, 4, False, 2)]
    assert index.table().count() == 3
    plan = index.unseen(index.table().groupBy("digest").count())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Exchange" not in plan


def plain_tree(rows, block=20, head=4):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said = hashlib.sha256(f"{len((role or '').encode())} {role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, said, role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % head
        full[c] = [*own.get(c - int(np.fmod(c, block)), [])[:h], *ts[h:]]
    members = {}
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        words = len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", node[-1][1]) if w]) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in below)
    ends = lambda node: ",".join(map(str, sorted(c for c in members[node] if len(full[c]) == len(node))))
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n], hashlib.sha256(ends(n).encode()).hexdigest()) for n, m in members.items()), key=repr)


TALK = "conv_id bigint, turn bigint, role string, text string"


def some_talks(seed=5):
    rng = random.Random(seed)
    rows = [(c, t, "ua"[t % 2], f"w{rng.randrange(2)} x\ty") for c in range(-30, 90) for t in range(rng.randrange(7)) if c != 40]
    rows += [(200, t, "u", f"same {t}") for t in range(25)] + [(220, t, "u", f"same {t}") for t in range(25)] + [(240, t, "u", f"same {t}") for t in range(9)]
    rows += [(300 + k, t, "u", f"line {t}") for k in range(0, 200, 20) for t in range(k // 20)]  # a ladder of beginnings
    return rows + [(7, None, None, None), (7, 1, "u", "tied"), (7, 1, "u", "tied"), (None, 1, "u", "lost"), (41, 0, "u", "a  b"), (42, 0, None, ""), (43, 0, "", None)]


@pytest.mark.parametrize("small", [False, True])
def test_tree_equals_a_plain_version(spark, monkeypatch, small):
    if small:  # long conversations and long lists of ids, on a small scale
        monkeypatch.setattr(tries, "STRETCH", 3)
        monkeypatch.setattr(tries, "PIECE", 2)
    rows = some_talks()
    talks = spark.createDataFrame([(*r, 1, {"a": 1}) for r in rows], f"{TALK}, depth int, said map<string, int>").repartition(5)
    got = sorted((tuple(r) for r in tries.prefix_tree(talks).collect()), key=repr)
    assert got == plain_tree(rows)


def test_tree_of_no_turns(spark):
    assert tries.prefix_tree(spark.createDataFrame([(None, 1, "u", "x")], TALK)).count() == 0
    one = [(1, 0, "u", "gone")]  # 1 takes its first turns from 0, which isn't there
    assert [tuple(r) for r in tries.prefix_tree(spark.createDataFrame(one, TALK)).collect()] == plain_tree(one)
