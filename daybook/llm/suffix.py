"""Suffix-array dedup: repeated byte strings are found in suffix arrays built by two-stage sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.text import FIRST, SECOND, as_bytes, mix, slices, stage

LENGTH = 400
# Length of the strings whose hashes decide which texts are sorted together.
GRAM = 128
# A gram that stands at more places than this is not sorted; its strings are counted one by one.
PLACES = 256
# Bytes of a leading text that share an array, and bytes that are sorted at one time.
STRETCH = 1024
BATCH_BYTES = 256 << 10


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Positions of the suffixes in the order of their first ``depth`` bytes or more.

    Only the suffixes smaller than their successors are sorted directly. A scan over the buckets of
    first bytes in ascending order induces the others: a suffix larger than its successor stands, in
    its bucket, in the order of the successors, before those that were sorted.
    """
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    # a suffix compares with its successor as its first byte does with the next that differs
    differs = np.append(np.flatnonzero(data[1:] != data[:-1]), n - 1)
    next_change = differs[np.searchsorted(differs, np.arange(n))]
    smaller = np.zeros(n, bool)
    inner = next_change < n - 1
    smaller[inner] = data[next_change[inner]] < data[next_change[inner] + 1]
    direct = np.array(
        sorted(np.flatnonzero(smaller).tolist(), key=lambda i: text[i : i + depth]), np.int64
    )
    edges = np.searchsorted(data[direct], np.arange(257)) if len(direct) else np.zeros(257, int)
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[data[-1]].append(np.array([n - 1]))
    order = []
    for byte in range(256):
        parts = induced[byte]
        wave = np.concatenate(parts) if parts else np.empty(0, np.int64)
        bucket = []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(data[before] == byte) & ~smaller[before]]
        bucket.append(direct[edges[byte] : edges[byte + 1]])
        whole = np.concatenate(bucket)
        if not len(whole):
            continue
        order.append(whole)
        before = whole[whole > 0] - 1
        before = before[(data[before] > byte) & ~smaller[before]]
        first = data[before]
        by_byte = np.argsort(first, kind="stable")
        cuts = np.flatnonzero(np.diff(first[by_byte])) + 1
        for group in np.split(before[by_byte], cuts):
            if len(group):
                induced[data[group[0]]].append(group)
    return np.concatenate(order)


def repeated(text: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """Of the sorted ``starts``, those whose next ``length`` bytes also stand at another one."""
    data = np.frombuffer(text, np.uint8)
    allowed = np.zeros(len(data), bool)
    allowed[starts] = True
    order = suffix_array(text, length)
    order = order[allowed[order]]
    if len(order) < 2:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(data, length)
    same = np.zeros(len(order) + 1, bool)  # whether a suffix has the whole length in common with the one before
    for at in range(0, len(order) - 1, 1024):
        a, b = order[at : at + 1024], order[at + 1 : at + 1025]
        same[at + 1 : at + 1 + len(b)] = (views[a[: len(b)]] == views[b]).all(axis=1)
    return np.sort(order[same[:-1] | same[1:]])


@dataclass
class Anchors:
    """Occurrences of grams that stand for strings: the strings that start at ``lo`` to ``hi`` - 1
    have their least gram, by hash, at ``place``. Positions are in the joined buffer."""

    buffer: bytes
    begins: np.ndarray
    owner: np.ndarray
    keys: np.ndarray
    place: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def find_anchors(texts: list[bytes], length: int, gram: int) -> Anchors:
    """The least gram of every string of ``length`` bytes of each text; equal strings have equal ones
    at equal distance, the first of several that are least."""
    buffer = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    none = np.empty(0, np.int64)
    if len(buffer) < length:
        return Anchors(buffer, begins, none, none.view(np.uint64), none, none, none)
    values = FIRST.table[np.frombuffer(buffer, np.uint8)]
    count = len(buffer) - gram + 1
    hashes = FIRST.spans(values, np.arange(count), np.arange(gram, gram + count))
    bits = np.uint64(max(1, count.bit_length()))
    ranked = (hashes >> bits << bits) | np.arange(count, dtype=np.uint64)
    width = length - gram + 1
    padded = np.full(-(-count // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:count] = ranked
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.concatenate([none, *[np.arange(b, b + s - length + 1) for b, s in zip(begins, sizes) if s >= length]])
    least = np.minimum(behind[starts], ahead[starts + width - 1])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if not len(starts):
        return Anchors(buffer, begins, none, none.view(np.uint64), none, none, none)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(starts)) - 1
    owner = np.searchsorted(begins, starts[at], "right") - 1
    return Anchors(buffer, begins, owner, hashes[place[at]], place[at], starts[at], starts[last] + 1)


_IDS = [("doc", "long"), ("m1", "long"), ("m2", "long")]
_ID_NAMES = [n for n, _ in _IDS]
_ID_SCHEMA = ", ".join(f"{n} {t}" for n, t in _IDS)


def _ids(piece: pa.RecordBatch, owner: np.ndarray) -> list[pa.Array]:
    return [pa.array(piece.column(n).to_numpy()[owner]) for n in _ID_NAMES]


def grams(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc, m1, m2, key, n, place`` : the anchors' grams of each text, how many places each stands
    at, and the first of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            found = find_anchors(as_bytes(piece.column("text")), length, gram)
            order = np.lexsort([found.place, found.keys, found.owner])
            owner, keys, place = found.owner[order], found.keys[order], found.place[order]
            new = np.ones(len(order), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
            at = np.flatnonzero(new)
            owner, n = owner[at], np.diff(np.append(at, len(order)))
            columns = [pa.array(keys[at].view(np.int64)), pa.array(n), pa.array(place[at] - found.begins[owner])]
            yield pa.RecordBatch.from_arrays([*_ids(piece, owner), *columns], [*_ID_NAMES, "key", "n", "place"])

    return texts.mapInArrow(run, f"{_ID_SCHEMA}, key long, n long, place long")


def _blocks_of(piece: pa.RecordBatch, found: Anchors) -> np.ndarray:
    """Row in the texts' lists of shared grams for every anchor, or -1."""
    lists = piece.column("shared")
    sizes = np.diff(lists.offsets.to_numpy())
    keys = lists.flatten().field("key").to_numpy(zero_copy_only=False).view(np.uint64)
    salt = mix(np.arange(piece.num_rows, dtype=np.uint64) + np.uint64(99))
    known = keys ^ np.repeat(salt, sizes)
    order = np.argsort(known)
    wanted = found.keys ^ salt[found.owner]
    if not len(known):
        return np.full(len(wanted), -1)
    at = order[np.minimum(np.searchsorted(known[order], wanted), len(known) - 1)]
    return np.where(known[at] == wanted, at, -1)


def _segments(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``block, doc, m1, m2, lo, size, bytes``: stretches of texts to be sorted together, each with
    ``size`` starts of strings from ``lo`` on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            found = find_anchors(as_bytes(piece.column("text")), length, gram)
            at = _blocks_of(piece, found)
            inside = piece.column("shared").flatten()
            rare = ~inside.field("common").to_numpy(zero_copy_only=False)
            blocks = inside.field("block").to_numpy(zero_copy_only=False)
            use = at >= 0
            use[use] = rare[at[use]]
            owner, lo, hi, block = found.owner[use], found.lo[use], found.hi[use], blocks[at[use]]
            new = np.ones(len(lo), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1]) | (lo[1:] != hi[:-1])
            first = np.flatnonzero(new)
            if not len(first):
                continue
            last = np.append(first[1:], len(lo)) - 1
            owner, block, lo, hi = owner[first], block[first], lo[first], hi[last]
            cut = pa.array([found.buffer[a : b + length - 1] for a, b in zip(lo, hi)], pa.binary())
            columns = [pa.array(lo - found.begins[owner]), pa.array(hi - lo), cut]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), *_ids(piece, owner), *columns], ["block", *_ID_NAMES, "lo", "size", "bytes"]
            )

    return texts.mapInArrow(run, f"block long, {_ID_SCHEMA}, lo long, size long, bytes binary")


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last of every run of consecutive numbers."""
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] != starts[:-1] + 1
    first = np.flatnonzero(new)
    return starts[first], starts[np.append(first[1:], len(starts)) - 1] + 1


def _sorted_repeats(segments: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """``doc, m1, m2, a, b``: ranges of starts of repeated strings, from suffix arrays over whole blocks."""
    names = [*_ID_NAMES, "lo", "size", "bytes"]

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        text = b"".join(r[-1] for r in rows)
        begins = np.cumsum([0, *[len(r[-1]) for r in rows]])
        starts = np.concatenate([np.arange(b, b + r[-2]) for b, r in zip(begins, rows)])
        found = repeated(text, starts, length)
        owner = np.searchsorted(begins, found, "right") - 1
        out = []
        for segment in np.unique(owner):
            row = rows[segment]
            shift = row[3] - begins[segment]
            out += [(*row[:3], int(a + shift), int(b + shift)) for a, b in zip(*_runs(found[owner == segment]))]
        columns = zip(*out) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*_ID_NAMES, "a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        block, group, size, group_size = None, [], 0, 0
        for batch in batches:
            rows = zip(*[batch.column(n).to_pylist() for n in names])
            for now, row in zip(batch.column("block").to_pylist(), rows):
                if now != block:
                    if len(group) > 1 or group and group[0][4] > 1:
                        held, size = held + group, size + group_size
                    block, group, group_size = now, [], 0
                    if size > batch_bytes:
                        yield solve(held)
                        held, size = [], 0
                group.append(row)
                group_size += len(row[-1])
        if held + group:
            yield solve(held + group)

    ordered = segments.repartition("block").sortWithinPartitions("block")
    return ordered.mapInArrow(run, f"{_ID_SCHEMA}, a long, b long")


def _counted_repeats(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """As ``_sorted_repeats``, for the strings of common grams, told apart by 128 bits of hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            found = find_anchors(as_bytes(piece.column("text")), length, gram)
            at = _blocks_of(piece, found)
            common = piece.column("shared").flatten().field("common").to_numpy(zero_copy_only=False)
            use = at >= 0
            use[use] = common[at[use]]
            if not use.any():
                continue
            size = found.hi[use] - found.lo[use]
            owner = np.repeat(found.owner[use], size)
            starts = np.repeat(found.lo[use] - np.cumsum(size) + size, size) + np.arange(size.sum())
            data = np.frombuffer(found.buffer, np.uint8)
            hashes = [h.spans(h.table[data], starts, starts + length).view(np.int64) for h in (FIRST, SECOND)]
            columns = [pa.array(starts - found.begins[owner]), *map(pa.array, hashes)]
            yield pa.RecordBatch.from_arrays([*_ids(piece, owner), *columns], [*_ID_NAMES, "a", "x", "y"])

    strings = texts.mapInArrow(run, f"{_ID_SCHEMA}, a long, x long, y long")
    several = strings.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    return strings.join(several, ["x", "y"]).select(*_ID_NAMES, "a", (F.col("a") + 1).alias("b"))


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """``doc, m1, m2, n_removed, n_spans, sha, kept`` of texts without the strings in ``ranges``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            gone, spans, kept = [], [], []
            for text, ranges in zip(as_bytes(piece.column("text")), piece.column("ranges")):
                inside = ranges.values
                depth = np.zeros(len(text) + 1, np.int64)
                np.add.at(depth, inside.field("a").to_numpy(), 1)
                np.add.at(depth, inside.field("b").to_numpy() + length - 1, -1)
                removed = np.cumsum(depth)[:-1] > 0
                gone.append(int(removed.sum()))
                spans.append(int(removed[0]) + int((removed[1:] & ~removed[:-1]).sum()))
                kept.append(np.frombuffer(text, np.uint8)[~removed].tobytes())
            columns = [
                pa.array(gone, pa.int64()),
                pa.array(spans, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                pa.array(kept, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*[piece.column(n) for n in _ID_NAMES], *columns], [*_ID_NAMES, "n_removed", "n_spans", "sha", "kept"]
            )

    return texts.mapInArrow(run, f"{_ID_SCHEMA}, n_removed long, n_spans long, sha string, kept binary")


def suffix_dedup(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, places: int = PLACES, stretch: int = STRETCH
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of texts as UTF-8 bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same
    or another document, overlaps included, all as in the input. ``kept`` has the bytes left, if some
    went and the text has no copy, else null. The steps:

    * Texts of ``length`` bytes or more that occur more than once go whole; of each distinct text one
      row, that of the smallest doc_id, takes part in what follows.
    * The least gram of a string, by hash, is the same wherever the string occurs. Texts in which a
      gram stands that stands elsewhere as well are read again.
    * All places of a gram get into one block, together with those of the grams near it in the text
      of the smallest doc_id. Each block's stretches of text are sorted into a suffix array; strings
      that agree with a neighbour over ``length`` bytes are repeats.
    * A gram at more than ``places`` places would make a block too large for a task. Its strings are
      counted by 128 bits of hash instead, one row per string, with partial counts before the shuffle.

    Null text is empty. Rows without a doc_id take part like others; rows repeated as they are copies
    of each other. Shorter texts lose nothing. One row per input row; no rows give no rows.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    text = F.coalesce("text", F.lit(""))
    marked = docs.select(
        F.col("doc_id"), doc.alias("doc"), text.alias("text"), F.xxhash64(text).alias("m1"), F.xxhash64(F.lit("again"), text).alias("m2")
    )
    told = marked.select("doc_id", *_ID_NAMES, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    told = stage(told, "told")
    distinct = told.groupBy("m1", "m2").agg(F.min("doc").alias("first"), F.count("*").alias("copies"))
    told = stage(told.join(distinct, ["m1", "m2"]), "copies")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)

    used = told.where(f"doc = first AND n_bytes >= {length}").select(*_ID_NAMES).distinct()
    found = stage(grams(marked.select(*_ID_NAMES, "text").where(F.octet_length("text") >= length), length, gram), "grams")
    found = found.join(used, _ID_NAMES).dropDuplicates([*_ID_NAMES, "key"])
    shared = found.groupBy("key").agg(
        F.sum("n").alias("total"), F.min("doc").alias("leader"), F.min_by("place", "doc").alias("at")
    ).where("total > 1")
    block = F.xxhash64("leader", F.floor(F.col("at") / stretch)).alias("block")
    shared = shared.select("key", block, (F.col("total") > places).alias("common"))
    lists = found.select(*_ID_NAMES, "key").join(shared, "key").groupBy(*_ID_NAMES)
    lists = lists.agg(F.collect_list(F.struct("key", "block", "common")).alias("shared"))
    hopeful = marked.select(*_ID_NAMES, "text").join(lists, _ID_NAMES).dropDuplicates(_ID_NAMES)
    hopeful = stage(hopeful, "hopeful")

    repeats = _sorted_repeats(_segments(hopeful, length, gram), length, BATCH_BYTES)
    repeats = repeats.unionByName(_counted_repeats(hopeful, length, gram))
    ranges = repeats.groupBy(*_ID_NAMES).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    cut = _cut(hopeful.drop("shared").join(ranges, _ID_NAMES), length).withColumnRenamed("sha", "cut_sha")

    out = told.join(cut, _ID_NAMES, "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0))).alias("n_spans"),
        F.when(whole, empty).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(~whole, F.col("kept")).alias("kept"),
    )
