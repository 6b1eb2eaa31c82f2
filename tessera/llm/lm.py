"""An interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Files of a model, all in one folder of the shared storage:
  words-<shard>.key / .n      hashes of the training words in order, and their counts; a word's id is its rank over all
  pairs-<shard>.key / .n      hashes of (previous id, id) in order, and their counts in a byte; the hash can be undone
  pairs-<shard>.often         place in the shard and count of the pairs that occur more often than a byte tells
  words-first, pairs-first    how many keys lie before each shard
  stats-<chunk>.n             by id: followers' total, distinct followers seen once, twice, more often, distinct predecessors
A shard holds the hashes that begin with its bits, so arrays grow with the corpus and no building task holds a whole
one. Workers map a shard when a text first needs it, and pages of it are in memory as far as they are read. Where the
shared storage isn't mounted, the workers of an executor share one local copy of the shards they have needed.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import KEPT, remainder, scratch, take_turn
from tessera.llm.warc import file_system

U, I = np.uint64, np.int64
END_WORD = int(np.uint64(0x9E3779B97F4A7C15).view(I))
BASE, BLANK_BYTES = 0xD1342543DE82EF95, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
#: Bytes of text that are hashed at once, and tokens that are counted before rows leave a task.
SLAB = 1 << 20
COUNTED = 2 << 20
#: Tokens for each shard of the pairs, about.
SHARD_TOKENS = 2 << 20
#: A pair's count takes a byte; from here on it is in a list of its own.
OFTEN = 255
#: Ids in a chunk of the stats.
CHUNK = 1 << 18
FIELDS = 5


# Words and pairs as 64-bit hashes


@lru_cache(maxsize=1)
def tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, powers of an odd base and of its inverse modulo 2**64, and which bytes are white space."""
    values = np.random.default_rng(1995).integers(0, 1 << 64, 256, U, endpoint=False)
    up, down = np.full(n, BASE, U), np.full(n, pow(BASE, -1, 1 << 64), U)
    up[0] = down[0] = 1
    blank = np.zeros(256, bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    return values, np.multiply.accumulate(up), np.multiply.accumulate(down), blank


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unmixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31)) ^ (x >> U(62))) * U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = (x ^ (x >> U(27)) ^ (x >> U(54))) * U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> U(30)) ^ (x >> U(60))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts in turn, an end after each text; and the end's place for each text."""
    data = b"\n".join(texts) + b"\n"
    values, up, down, blank = tables(max(1 << (len(data) - 1).bit_length(), 2 * SLAB))
    raw = np.frombuffer(data.lower(), np.uint8)
    white = np.r_[True, blank[raw]]
    edge = np.diff(white.astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.r_[U(0), np.cumsum(values[raw] * up[: len(raw)], dtype=U)]
    words = mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(U)).view(I)
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    before = np.searchsorted(first, stops)
    ends = before + np.arange(len(texts))
    out = np.empty(len(words) + len(texts), I)
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word], out[ends] = words, END_WORD
    return out, ends


@dataclass
class Lot:
    """Tokens of some whole texts, or of a part of a long one: rows of the batch, and whether its text begins and ends here."""

    rows: list[int]
    batch: pa.RecordBatch
    found: np.ndarray
    ends: np.ndarray
    first: bool = True
    last: bool = True


def lots(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[Lot]:
    """The batches' texts as tokens, about SLAB bytes of text at a time however long a text is."""
    for batch in batches:
        rows, texts, held = [], [], 0
        for k, x in enumerate(batch.column(column)):
            data = memoryview(x.as_buffer() or b"")
            if len(data) > 2 * SLAB:
                if rows:
                    yield Lot(rows, batch, *tokens(texts))
                    rows, texts, held = [], [], 0
                yield from long_text(k, batch, data)
                continue
            rows.append(k)
            texts.append(bytes(data))
            held += len(data)
            if held >= SLAB:
                yield Lot(rows, batch, *tokens(texts))
                rows, texts, held = [], [], 0
        if rows:
            yield Lot(rows, batch, *tokens(texts))


def long_text(row: int, batch: pa.RecordBatch, data: memoryview) -> Iterator[Lot]:
    """A long text part by part; parts end at white space, and a word longer than a part is a part of its own."""
    at, n, none = 0, len(data), np.zeros(0, I)
    while at < n:
        part = bytes(data[at : at + SLAB])
        cut = n - at if at + SLAB >= n else max(part.rfind(c) for c in BLANK_BYTES) + 1
        if cut:
            found, _ = tokens([part[:cut]])
            found = found[:-1]
        else:
            found, cut = long_word(data, at)
        yield Lot([row], batch, found, none, at == 0, False)
        at += cut
    yield Lot([row], batch, np.array([END_WORD], I), np.array([0]), n == 0, True)


def long_word(data: memoryview, at: int) -> tuple[np.ndarray, int]:
    """The token of the word that begins at a place, and its length."""
    values, up, _, blank = tables(2 * SLAB)
    total, length = 0, 0
    while at + length < len(data):
        raw = np.frombuffer(bytes(data[at + length : at + length + SLAB]).lower(), np.uint8)
        white = np.flatnonzero(blank[raw])
        raw = raw[: white[0]] if len(white) else raw
        part = int((values[raw] * up[: len(raw)]).sum(dtype=U))
        total = (total + part * pow(BASE, length, 1 << 64)) % (1 << 64)
        length += len(raw)
        if len(white):
            break
    return mixed(np.array([(total + length) % (1 << 64)], U)).view(I), length


# Arrays on shared storage


class Folder:
    """Files of a model, by name. From storage that isn't mounted each is fetched once an executor, when it is needed."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.mounted = bool(re.match(r"file:|/", uri))
        self.local = self.path if self.mounted else os.path.join(tempfile.gettempdir(), f"tessera-lm-{xxhash.xxh64_hexdigest(uri)}")

    def read(self, name: str, kind) -> np.ndarray:
        """A mapped array. A file that isn't there is an error."""
        path = os.path.join(self.local, name)
        if not self.mounted and not os.path.exists(path):
            os.makedirs(self.local, exist_ok=True)
            own = f"{path}.{uuid.uuid4().hex}"
            pafs.copy_files(posixpath.join(self.path, name), own, source_filesystem=self.fs)
            os.replace(own, path)
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


class Sorted:
    """Sorted keys with counts in shards by their first bits. A shard is mapped when it is first looked into; one that
    hasn't as many keys as the build has recorded is an error, not an empty shard."""

    def __init__(self, folder: Folder, name: str, bits: int, kind):
        self.folder, self.name, self.bits, self.kind = folder, name, bits, kind
        self.first = folder.read(f"{name}-first", I)
        self.open: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, counts, and places and counts of those too great for their kind."""
        if k not in self.open:
            path = f"{self.name}-{k}"
            keys, counts = self.folder.read(f"{path}.key", I), self.folder.read(f"{path}.n", self.kind)
            often = self.folder.read(f"{path}.often", I).reshape(-1, 2) if self.kind == np.uint8 else np.zeros((0, 2), I)
            size = self.first[k + 1] - self.first[k]
            if len(keys) != size or len(counts) != size or (self.kind == np.uint8 and len(often) != np.count_nonzero(counts == OFTEN)):
                raise FileNotFoundError(f"{self.folder.local}/{path} has {len(keys)} of {size} keys, or files beside it are not whole")
            self.open[k] = keys, counts, often
        return self.open[k]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (-1: absent) and count of each."""
        own, back = np.unique(wanted, return_inverse=True)
        rank, count = np.full(len(own), -1, I), np.zeros(len(own), I)
        shard = shards(own, self.bits)
        cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(own) else []
        for a, b in zip(cut, [*cut[1:], len(own)], strict=True):
            k = int(shard[a])
            if self.first[k + 1] == self.first[k]:
                continue
            keys, counts, often = self.shard(k)
            at = np.minimum(np.searchsorted(keys, own[a:b]), len(keys) - 1)
            ok = keys[at] == own[a:b]
            n = counts[at].astype(I)
            if len(often) and (more := n == OFTEN).any():
                n[more] = often[np.minimum(np.searchsorted(often[:, 0], at[more]), len(often) - 1), 1]
            rank[a:b] = np.where(ok, at + self.first[k], -1)
            count[a:b] = np.where(ok, n, 0)
        return rank[back], count[back]


@lru_cache(maxsize=2)
def known_words(uri: str, bits: int) -> Sorted:
    return Sorted(Folder(uri), "words", bits, I)


def shards(keys: np.ndarray, bits: int) -> np.ndarray:
    """Shard of each key: its first bits, in the order of signed numbers."""
    return (keys >> I(64 - bits)) + (1 << (bits - 1))


def packed(x: np.ndarray) -> bytes:
    """Ascending whole numbers, or small ones: byte by byte, compressed."""
    return zstandard.compress(np.ascontiguousarray(np.diff(x, prepend=I(0)).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view(I).ravel())


def counted(held: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Distinct keys and how many there are, a row for each shard."""
    own, n = np.unique(np.concatenate(held), return_counts=True)
    cut = np.searchsorted(shards(own, bits), np.arange((1 << bits) + 1))
    rows = [(k, packed(own[a:b]), packed(n[a:b].astype(I))) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["shard", "keys", "n"])


COUNTS = "shard bigint, keys binary, n binary"


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """From rows of counted(), of which a task has all of its shards: each shard's distinct keys in order, and their sums."""
    held: dict[int, list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        for shard, keys, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            held.setdefault(shard, []).append((keys, n))
    for shard in sorted(held):
        rows = held.pop(shard)
        keys, n = (np.concatenate([unpacked(r[k]) for r in rows]) for k in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        yield shard, keys[at], np.add.reduceat(n, at)


class ShardFiles:
    """Files of one task; they get their names once whole, so that a task that runs again replaces them."""

    def __init__(self, uri: str):
        (self.fs, self.path), self.open, self.mark = file_system(uri), {}, uuid.uuid4().hex

    def add(self, name: str, data: np.ndarray) -> None:
        if name not in self.open:
            self.fs.create_dir(self.path, recursive=True)
            self.open[name] = self.fs.open_output_stream(posixpath.join(self.path, f"_{name}.{self.mark}"))
        self.open[name].write(np.ascontiguousarray(data).tobytes())

    def close(self) -> None:
        for name, stream in self.open.items():
            stream.close()
            self.fs.move(posixpath.join(self.path, f"_{name}.{self.mark}"), posixpath.join(self.path, name))


# Counting


def let_go() -> None:
    for kept in (known_words, opened, tables):
        kept.cache_clear()


KEPT["lm"] = let_go


def count_words(texts: DataFrame, bits: int) -> DataFrame:
    def run(batches):
        take_turn("lm")
        held, n = [], 0
        for lot in lots(batches, 0):
            held.append(lot.found)
            n += len(lot.found)
            if n >= COUNTED:
                yield counted(held, bits)
                held, n = [], 0
        if held:
            yield counted(held, bits)

    return texts.mapInArrow(run, COUNTS)


def count_pairs(texts: DataFrame, uri: str, word_bits: int, bits: int, start: int) -> DataFrame:
    def run(batches):
        known, held, n, last = known_words(uri, word_bits), [], 0, start
        for lot in lots(batches, 0):
            ids = known.find(lot.found)[0]
            held.append(mixed(previous(ids, lot.ends, start if lot.first else last, start).astype(U) << U(32) | ids.astype(U)).view(I))
            n, last = n + len(ids), ids[-1] if len(ids) else last
            if n >= COUNTED:
                yield counted(held, bits)
                held, n = [], 0
        if held:
            yield counted(held, bits)

    return texts.mapInArrow(run, COUNTS)


def previous(ids: np.ndarray, ends: np.ndarray, last: int, start: int) -> np.ndarray:
    """Of each id the one before: `last` of the first one, `start` after an end."""
    before = np.r_[I(last), ids][: len(ids)]
    before[ends[:-1] + 1] = start
    return before


def write_words(counts: DataFrame, uri: str, bits: int) -> DataFrame:
    """(shard, words, tokens) for each shard."""

    def run(batches):
        files, rows = ShardFiles(uri), []
        for shard, keys, n in merged(batches):
            files.add(f"words-{shard}.key", keys)
            files.add(f"words-{shard}.n", n)
            rows.append((shard, len(keys), int(n.sum())))
        files.close()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["shard", "words", "tokens"])

    return counts.repartition(1 << bits, "shard").mapInArrow(run, "shard bigint, words bigint, tokens bigint")


STATS = "chunk bigint, ids binary, total binary, n1 binary, n2 binary, n3 binary, preds binary"


def write_pairs(counts: DataFrame, uri: str, bits: int) -> DataFrame:
    """Sums for each id, a row for each chunk of ids and shard of pairs; and for each shard, as chunk -1 - shard, the
    number of its pairs, and of those that occur once, twice, three and four times."""

    def run(batches):
        files = ShardFiles(uri)
        rows: list[tuple] = []
        for shard, keys, n in merged(batches):
            files.add(f"pairs-{shard}.key", keys)
            files.add(f"pairs-{shard}.n", np.minimum(n, OFTEN).astype(np.uint8))
            files.add(f"pairs-{shard}.often", np.stack([np.flatnonzero(n >= OFTEN), n[n >= OFTEN]], 1))
            pair = unmixed(keys.view(U))
            u, w = (pair >> U(32)).astype(I), (pair & U(0xFFFFFFFF)).astype(I)
            ids, at = np.unique(np.r_[u, w], return_inverse=True)
            first, second = at[: len(u)], at[len(u) :]
            cols = [np.bincount(first, x, len(ids)).astype(I) for x in (n, n == 1, n == 2, n >= 3)] + [np.bincount(second, minlength=len(ids)).astype(I)]
            cut = np.flatnonzero(np.r_[True, np.diff(ids // CHUNK) > 0])
            rows += ((int(ids[a] // CHUNK), packed(ids[a:b]), *(packed(c[a:b]) for c in cols)) for a, b in zip(cut, [*cut[1:], len(ids)], strict=True))
            rows.append((-1 - shard, packed(np.array([len(n), *((n == k).sum() for k in (1, 2, 3, 4))], I)), *[b""] * 5))
            yield stats_rows(rows)
            rows = []
        files.close()

    return counts.repartition(1 << bits, "shard").mapInArrow(run, STATS)


def stats_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int64()) for k in range(7)], ["chunk", "ids", "total", "n1", "n2", "n3", "preds"])


def write_stats(sums: DataFrame, uri: str, chunks: int) -> DataFrame:
    """(chunk, pairs, 1, 2, 3, 4, more): how many pairs, and how many of them or of a chunk's ids have so many
    occurrences or predecessors; negative chunks are shards of pairs."""

    def run(batches):
        files, meta = ShardFiles(uri), []
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, ids, *cols in zip(*(batch.column(k) for k in range(7)), strict=True):
                chunk, ids = chunk.as_py(), unpacked(ids.as_py())
                if chunk < 0:
                    meta.append((chunk, *map(int, ids), 0))
                    continue
                own = held.setdefault(chunk, np.zeros((CHUNK, FIELDS)))
                own[ids - chunk * CHUNK] += np.stack([unpacked(c.as_py()) for c in cols], 1)
        for chunk, own in held.items():
            files.add(f"stats-{chunk}.n", own)
            preds = own[:, 4]
            meta.append((chunk, int(preds.sum()), *(int((preds == k).sum()) for k in (1, 2, 3, 4)), int((preds >= 3).sum())))
        files.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in meta], pa.int64()) for k in range(7)], ["chunk", "pairs", "n1", "n2", "n3", "n4", "more"])

    return sums.repartition(chunks, "chunk").mapInArrow(run, "chunk bigint, pairs bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, more bigint")


def write_first(uri: str, name: str, bits: int, sizes: dict[int, int]) -> None:
    files = ShardFiles(uri)
    files.add(f"{name}-first", np.cumsum([0, *(sizes.get(k, 0) for k in range(1 << bits))]).astype(I))
    files.close()


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more; where the counts of counts are too few to tell, 0.5, 1 and 1.5."""
    if not (n1 and n2 and n3 and n4):
        return [0.0, 0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [0.0, *(float(np.clip(d, 0.05 * k, 0.95 * k)) for k, d in enumerate(found, 1))]


def build(docs: DataFrame, uri: str | None = None) -> dict:
    """Counts the texts of `docs` (one column, text) and writes the model; returns what workers need besides the files.

    Nulls count as empty: a lone end. The corpus is read twice. Tasks sum words and pairs before they are dealt by
    hash, so a frequent word or pair is no task's burden; what is dealt is packed sorted arrays, and the number of
    shards follows the shuffle partitions and the corpus, so that a shard is some MB. The driver gets a row a shard.
    """
    spark = docs.sparkSession
    uri = uri or scratch(spark, "lm")
    word_bits = max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    meta = write_words(count_words(docs, word_bits), uri, word_bits).collect()
    write_first(uri, "words", word_bits, {r["shard"]: r["words"] for r in meta})
    size, total = sum(r["words"] for r in meta), sum(r["tokens"] for r in meta)
    bits = max(word_bits, (total // SHARD_TOKENS).bit_length())
    model = {"uri": uri, "word_bits": word_bits, "bits": bits, "words": size, "tokens": total, "pairs": 0, "pair_discounts": discounts(0, 0, 0, 0), "word_discounts": discounts(0, 0, 0, 0), "rest": 1.0, "chunks": []}
    if not total:
        return model
    stats = write_stats(write_pairs(count_pairs(docs, uri, word_bits, bits, size), uri, bits), uri, size // CHUNK + 1).collect()
    ids, pairs = ([r for r in stats if (r["chunk"] < 0) == x] for x in (False, True))
    write_first(uri, "pairs", bits, {-1 - r["chunk"]: r["pairs"] for r in pairs})
    add = lambda rows, c: sum(r[c] for r in rows)
    model["pairs"], model["chunks"] = add(ids, "pairs"), sorted(r["chunk"] for r in ids)
    model["pair_discounts"] = discounts(*(add(pairs, c) for c in ("n1", "n2", "n3", "n4")))
    d = model["word_discounts"] = discounts(*(add(ids, c) for c in ("n1", "n2", "n3", "n4")))
    model["rest"] = (d[1] * add(ids, "n1") + d[2] * add(ids, "n2") + d[3] * add(ids, "more")) / model["pairs"]
    return model


# Scoring


class Model:
    """Mapped arrays, and probabilities from them."""

    def __init__(self, about: dict):
        self.folder, self.about = Folder(about["uri"]), about
        self.words = known_words(about["uri"], about["word_bits"])
        self.pairs = Sorted(self.folder, "pairs", about["bits"], np.uint8) if about["pairs"] else None
        self.recorded = set(about["chunks"])
        self.stats: dict[int, np.ndarray] = {}

    def chunk(self, k: int) -> np.ndarray:
        if k not in self.stats:
            self.stats[k] = self.folder.read(f"stats-{k}.n", np.float64).reshape(-1, FIELDS)
        return self.stats[k]

    def facts(self, ids: np.ndarray) -> np.ndarray:
        """The stats of ids; zeros for -1."""
        own, back = np.unique(ids, return_inverse=True)
        out, chunk = np.zeros((len(own), FIELDS), np.float64), own // CHUNK
        for c in np.unique(chunk[own >= 0]):
            if c in self.recorded:
                out[chunk == c] = self.chunk(int(c))[own[chunk == c] - c * CHUNK]
        return out[back]

    def log10(self, found: np.ndarray, ends: np.ndarray, last: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """log10 p(token | the one before) of tokens, their training counts, and the last id. `last`: the id before the
        first token, if a text doesn't begin with it."""
        a = self.about
        ids, count = self.words.find(found)
        before = previous(ids, ends, a["words"] if last is None else last, a["words"])
        key = mixed(np.maximum(before, 0).astype(U) << U(32) | np.maximum(ids, 0).astype(U)).view(I)
        met = (self.pairs.find(key)[1] if self.pairs else np.zeros(len(ids), I)) * ((ids >= 0) & (before >= 0))
        less = lambda n, d: np.maximum(n - np.asarray(d)[np.minimum(n, 3).astype(int)], 0)
        preds, after = self.facts(ids)[:, 4], self.facts(before)
        lower = less(preds, a["word_discounts"]) / max(1, a["pairs"]) + a["rest"] / (a["words"] + 1)
        total, d = after[:, 0], a["pair_discounts"]
        seen = np.maximum(total, 1)
        free = np.where(total > 0, (d[1] * after[:, 1] + d[2] * after[:, 2] + d[3] * after[:, 3]) / seen, 1.0)
        return np.log10(less(met, d) / seen + free * lower), count, int(ids[-1]) if len(ids) else last


@lru_cache(maxsize=2)
def opened(about: str) -> Model:
    return Model(json.loads(about))


def score(docs: DataFrame, about: dict) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row, over its whole text."""
    told = json.dumps(about)

    def run(batches):
        take_turn("lm")
        model = opened(told)
        n, v = about["tokens"], about["words"]
        part, last = np.zeros(4), None
        for lot in lots(batches):
            log, count, last = model.log10(lot.found, lot.ends, None if lot.first else last)
            base = np.log10((count + 1) / (n + v + 1))
            if not (lot.first and lot.last):  # a part of a long text
                part += [len(lot.found), (count > 0).sum(), base.sum(), log.sum()]
                if not lot.last:
                    continue
                sums, part = part[:, None], np.zeros(4)
            else:
                first = np.r_[0, lot.ends[:-1] + 1]
                sums = np.stack([lot.ends - first + 1, *(np.add.reduceat(x, first) for x in ((count > 0).astype(float), base, log))])
            size, known, base_sum, total = sums
            columns = [lot.batch.column(0).take(pa.array(lot.rows)), pa.array(size.astype(I)), pa.array(known.astype(I)), pa.array(np.full(len(lot.rows), n, I)), pa.array(base_sum), pa.array(total), pa.array(10 ** (-total / size))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


def score_documents(docs: DataFrame, by: int = 7, held: int = 2) -> DataFrame:
    """Every document's log10 probability under a model of the documents with crc32(doc_id) mod `by` other than `held`.

    Null and empty texts are one end token. A null doc_id is held out. Without training documents every token is
    equally unknown: score 0, and base_score 0. Repeated rows count and are scored each; other columns aren't read.
    """
    out = remainder(F.col("doc_id"), by) == held
    learn = docs.where(F.coalesce(~out, F.lit(False))).select(F.col("text").cast("string"))
    scored = score(docs, build(learn))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), by) == held, F.lit(True)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
