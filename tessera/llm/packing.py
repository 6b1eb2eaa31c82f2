"""Packing documents into training sequences by minimum bin slack."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import KEPT, take_turn, written

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint"
#: Word forms in each of the two generations a worker keeps, some 220 MB together with their ids.
CACHED_WORDS = 500_000
#: Characters that are split into words at once.
SLAB = 1 << 20
#: Words of letters that are encoded as one line.
LINE = 64
#: Signs that are a piece of the vocabulary's split of their own after letters.
TAIL = ".,;:!?%$#&*)"
#: Whether a word is of lower-case letters of Latin-1 alone; and such letters in any case, whose case is folded one by one, with signs after them, or anything else, of each of some lines.
LATIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
PARTS = re.compile(rf"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(TAIL)}]*)|(.*))$", re.M)
#: Pieces that are packed together, on average.
GROUP_PIECES = 4_000


class WordIds:
    """Little-endian ids of words. The vocabulary splits at white space, so a text's ids are its words' ids in turn.

    New words are encoded many at a time. A word of letters is one piece of the vocabulary's split, whose last id alone
    bears the mark of a word's end; that tells where in a line of such words each one's ids stop. Signs after its
    letters are a piece of their own, and the vocabulary folds case. Words of Latin letters in lower case stay as they
    are when the vocabulary normalises and splits them, so they go to its merges directly.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.cached = cached
        self.model = Tokenizer.from_file(path)
        own = json.loads(self.model.to_str())
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        own |= {"normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}}
        self.latin = Tokenizer.from_str(json.dumps(own))
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, "<u4") for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def latin_ids(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of lower-case Latin letters, by the ends of words among those of all."""
        lines = [" ".join(words[k : k + LINE]) for k in range(0, len(words), LINE)]
        ids = np.fromiter(chain.from_iterable(x.ids for x in self.latin.encode_batch_fast(lines, add_special_tokens=False)), "<u4")
        data, stops = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        return {x: data[at:stop] for x, at, stop in zip(words, [0, *stops[:-1]], stops, strict=True)} if words else {}

    def other_ids(self, words: list[str]) -> dict[str, bytes]:
        """Ids of any words; those of letters are encoded LINE at once."""
        letters, odd = [x for x in words if x.isalpha()], [x for x in words if not x.isalpha()]
        found = {x: ids.tobytes() for x, ids in zip(odd, self.encode(odd), strict=True)}
        lines = [letters[k : k + LINE] for k in range(0, len(letters), LINE)]
        for own, ids in zip(lines, self.encode([" ".join(x) for x in lines]), strict=True):
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) == len(own):
                data = ids.tobytes()
                found |= {x: data[at:stop] for x, at, stop in zip(own, [0, *stops[:-1]], stops, strict=True)}
            else:  # a letter that the split doesn't count as one
                found |= {x: one.tobytes() for x, one in zip(own, self.encode(own), strict=True)}
        return found

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words; a stem that is known already isn't encoded again."""
        parts = [(stem.lower(), tail) if stem else split_tail(other) for stem, tail, other in PARTS.findall("\n".join(words))]
        stems = {x for x, _ in parts}.union({tail for _, tail in parts})
        found = {x: ids for x in stems if (ids := self.known.get(x) or self.older.get(x)) is not None}
        found[""] = b""
        new = [x for x in stems if x not in found]
        latin = {x for x in new if LATIN(x)}
        found |= self.latin_ids(list(latin)) | self.other_ids([x for x in new if x not in latin])
        return {w: found[stem] + found[tail] if tail else found[stem] for w, (stem, tail) in zip(words, parts, strict=True)}

    def of(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        ids = [list(map(self.known.get, words)) for words in split]
        gaps = [[k for k, x in enumerate(own) if x is None] for own in ids]
        new = {words[k] for words, own in zip(split, gaps, strict=True) for k in own}
        if new:
            found = {w: self.older[w] for w in new & self.older.keys()}
            found |= self.learn([w for w in new if w not in found])
            if len(self.known) + len(found) > self.cached:
                self.known, self.older = {"": b""}, self.known
            self.known |= found
            for words, own, missing in zip(split, ids, gaps, strict=True):
                for k in missing:
                    own[k] = found[words[k]]
        return [b"".join(own) for own in ids]


def split_tail(word: str) -> tuple[str, str]:
    """A word of letters and the signs after them, or any other word as it is."""
    stem = word.rstrip(TAIL)
    return (stem, word[len(stem) :]) if stem.isalpha() else (word, "")


def lots(texts: Iterable[str]) -> Iterator[list[tuple[int, str]]]:
    """(position, text), about SLAB characters at a time; a longer text comes in parts that end at a space."""
    held, size = [], 0
    for k, text in enumerate(texts):
        at = 0
        while len(text) - at > SLAB:
            cut = text.find(" ", at + SLAB)
            cut = len(text) if cut < 0 else cut
            yield [*held, (k, text[at:cut])]
            held, size, at = [], 0, cut
        held.append((k, text[at:]))
        size += len(text) - at
        if size > SLAB:
            yield held
            held, size = [], 0
    if held:
        yield held


@lru_cache(maxsize=2)
def word_ids(path: str, cached: int) -> WordIds:
    return WordIds(path, cached)


KEPT["packing"] = word_ids.cache_clear


def pieces(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Each document's ids, `end_id` last, cut at multiples of `window`. A null text counts as empty: one id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("packing")
        known, end = word_ids(tokenizer, cached_words), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            whole = [b""] * batch.num_rows
            rows: list[tuple] = []
            for lot in lots(x.as_py() or "" for x in batch.column(1)):
                for (k, _), ids in zip(lot, known.of([t for _, t in lot]), strict=True):
                    whole[k] += ids
            for doc_id, ids in zip(doc_ids, whole, strict=True):
                rows += pieces_of(doc_id, ids + end, window)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pieces_of(doc_id: int | None, ids: bytes, window: int) -> list[tuple]:
    n = len(ids) // 4
    return [(doc_id, at, min(window, n - at), zlib.crc32(ids[4 * at : 4 * (at + window)]), n) for at in range(0, n, window)]


def closest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The (length, how many) that fill `room` as closely as the multiset `counts` allows.

    Bit s of a bitset tells whether a sum s can be had. Lengths enter from the longest, in lots of 1, 2, 4 ...
    copies, until `room` itself can be had; the lots that lead to the best sum are found on the way back.
    """
    sums, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left:
            take = min(lot, left)
            steps.append((sums, length, take))
            sums |= (sums << (take * length)) & mask
            left, lot = left - take, 2 * lot
        if sums >> room:
            break
    at, picked = sums.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            picked[length] = picked.get(length, 0) + take
            at -= take * length
    return list(picked.items())


def fill(lengths: Iterable[int], window: int) -> list[list[int]]:
    """Positions of `lengths`, as windows: the longest one left opens a window, the closest fit of the rest fills it."""
    at: dict[int, list[int]] = {}
    for k, length in enumerate(lengths):
        at.setdefault(int(length), []).append(k)
    counts, out = {length: len(x) for length, x in at.items()}, []

    def take(length: int, n: int) -> list[int]:
        counts[length] -= n
        if not counts[length]:
            del counts[length]
        return [at[length].pop() for _ in range(n)]

    while counts:
        longest = max(counts)
        own = take(longest, 1)
        for length, n in closest(counts, window - longest) if longest < window else ():
            own += take(length, n)
        out.append(own)
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, group_pieces: int = GROUP_PIECES, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Sequences of at most `window` ids from the documents; a row for each piece.

    Pieces are dealt by a hash of their own content into groups of about `group_pieces`, whose lengths alone are
    packed, each group in one task; a hot source or a long document is spread like anything else, and so are pieces
    that are all alike, which are counted first and told apart by their number. Where a piece goes depends on no
    partition. A group leaves at most a few windows with room. Rows that repeat, even with the same id, are documents
    of their own; null ids stay null; no documents give no rows. Columns but doc_id and text aren't read.
    `cached_words` is what a worker's memory is traded for speed with; it changes no row.
    """

    def fit(frame):
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32", "doc_tokens", "copy"], kind="stable").reset_index(drop=True)
        group, lengths = int(frame["salt"].iloc[0]), frame["length"].to_numpy()
        sequence, offset = np.zeros(len(frame), "int64"), np.zeros(len(frame), "int64")
        for k, own in enumerate(fill(lengths, window)):
            sequence[own] = (group << 32) + k
            offset[own] = np.cumsum([0, *lengths[own][:-1]])
        return frame.drop(columns=["salt", "copy"]).assign(sequence_id=sequence, offset=offset)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    alike = written(pieces(docs, tokenizer, window, end_id, cached_words).groupBy(*names).agg(F.count(F.lit(1)).alias("copies")), "pieces")
    groups = max(1, -(-(alike.agg(F.sum("copies")).first()[0] or 0) // group_pieces))
    each = alike.select(*names, F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    salt = F.pmod(F.xxhash64(*names, "copy"), F.lit(groups))
    return each.withColumn("salt", salt).groupBy("salt").applyInPandas(fit, PACKED)
