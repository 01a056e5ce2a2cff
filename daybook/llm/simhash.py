"""SimHash near-duplicates: fingerprints, bit-sliced comparison within multi-index blocks, groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.components import components
from daybook.llm.text import as_bytes, slices, stage

RADIUS = 3
SHINGLE = 3
# The 64 bits in RADIUS + 2 fields: two fingerprints within the radius agree on two whole fields.
FIELDS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
# Largest number of fingerprints compared with each other in one piece of work.
BLOCK = 4096


def _fingerprint(text: bytes, width: int) -> int:
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    cuts = [0]
    for word in found:
        cuts.append(cuts[-1] + len(word) + 1)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], 42) for a, b in zip(cuts, cuts[width:])]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 32768):
        block = np.array(hashes[at : at + 32768], np.uint64)
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: 64-bit SimHash of each text over shingles of ``width`` lower-cased words.

    Shingle hashes are XXH64 with seed 42; a bit is set if it is set in over half of them, repeats
    counted. A text of fewer words is one shingle; null, empty and blank texts have fingerprint 0.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            values = [_fingerprint(t, width) for t in as_bytes(piece.column("text"))]
            signed = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), signed], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _planes(block: np.ndarray) -> np.ndarray:
    """Bit planes, one row per bit, 64 fingerprints in a word."""
    padded = np.zeros(-(-len(block) // 64) * 64, np.uint64)
    padded[: len(block)] = block
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _within(queries: np.ndarray, planes: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Query index and positions of the block within three bits, for the queries that have any.

    The differing bits of 64 members at once are counted plane by plane in a carry-save counter of
    two binary digits and an overflow; a query leaves the block once all its members overflow.
    """
    width = planes.shape[1]
    every = np.full(width, np.iinfo(np.uint64).max, np.uint64)
    if size % 64:
        every[-1] = np.uint64((1 << (size % 64)) - 1)
    alive = np.arange(len(queries))
    low = np.zeros((len(queries), width), np.uint64)
    high, over = low.copy(), np.broadcast_to(~every, low.shape).copy()
    for bit in range(64):
        flip = np.uint64(0) - ((queries[alive] >> np.uint64(bit)) & np.uint64(1))
        differ = planes[bit] ^ flip[:, None]
        carry = low & differ
        low ^= differ
        over |= high & carry
        high ^= carry
        if bit % 8 == 7:
            stay = ~(over == np.iinfo(np.uint64).max).all(axis=1)
            if not stay.all():
                alive, low, high, over = alive[stay], low[stay], high[stay], over[stay]
            if not len(alive):
                return
    near = ~over
    for row, query in enumerate(alive):
        bits = np.unpackbits(near[row].view(np.uint8), bitorder="little")
        yield int(query), np.flatnonzero(bits[:size])


def _links(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what lies within the radius, one for each merge of two groups.

    ``left`` is compared with ``right`` in blocks; a pair whose groups are already joined gives no
    further link, so the output is linear in the members.
    """
    parent: dict[int, int] = {}
    links = []

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def tie(a: int, others: np.ndarray) -> None:
        for b in map(int, others):
            x, y = root(a), root(b)
            if x != y:
                parent[x] = y
                links.append((a, b))

    if len(left) * len(right) <= 1024:  # too few to fill a plane: compare whole words
        near = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
        for a, row in zip(map(int, left), near):
            tie(a, right[row])
        return links
    for at in range(0, len(right), 1024):
        block = right[at : at + 1024]
        planes = _planes(block)
        for start in range(0, len(left), 512):
            queries = left[start : start + 512]
            for query, found in _within(queries, planes, len(block)):
                tie(int(queries[query]), block[found])
    return links


def near_links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``a, b``: links among the distinct fingerprints ``fp``, enough to join every pair in the radius.

    Every fingerprint enters ten tables, one for each two of five fields, keyed by the bits of the
    two; a pair within three bits meets in one table at least. A key with more than ``block``
    members is split into parts of about that size and each two parts are compared in a piece of
    work of their own, so that no task holds a whole large key.
    """
    if radius != RADIUS:
        raise ValueError("the fields and the counter are laid out for a radius of 3")
    fp = F.col("fp")
    tables = []
    for number, pair in enumerate(combinations(FIELDS, 2)):
        mask = sum(((1 << width) - 1) << shift for shift, width in pair)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        tables.append(F.struct(F.lit(number).alias("t"), fp.bitwiseAND(F.lit(mask)).alias("k")))
    keyed = distinct.select("fp", F.inline(F.array(*tables)))
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    met = keyed.join(sizes, ["t", "k"]).withColumn("parts", parts)
    met = met.withColumn("part", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = met.select("t", "k", "fp", "part", other.alias("other"))
    met = met.select(
        "t", "k", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "fp", "part"
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(key: tuple, rows: list) -> list[tuple[int, int]]:
            fps = np.concatenate([r[0] for r in rows]).view(np.uint64)
            part = np.concatenate([r[1] for r in rows])
            left = fps[part == key[2]]
            right = left if key[2] == key[3] else fps[part == key[3]]
            return _links(left, right, radius)

        key, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("t", "k", "x", "y", "fp", "part")]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)) + 1
            found = []
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if a == b:
                    continue
                here = tuple(int(c[a]) for c in columns[:4])
                if here != key and rows:
                    found += flush(key, rows)
                    rows = []
                key = here
                rows.append((columns[4][a:b], columns[5][a:b]))
            yield _pairs(found)
        if rows:
            yield _pairs(flush(key, rows))

    order = ["t", "k", "x", "y"]
    return met.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    flat = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest doc_id linked to each document, itself included.

    Documents link at three or fewer differing bits; empty texts share fingerprint 0 and link like
    any other. Rows with a null doc_id are kept: they link, but never name a group; a group of such
    rows alone has a null component. Repeated rows stay repeated. No rows give no rows.
    """
    marks = stage(fingerprints(docs), "fingerprints")
    distinct = stage(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    groups = components(near_links(distinct.select("fp")))
    tied = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    tied = tied.withColumn("component", F.coalesce("component", "fp"))
    smallest = tied.groupBy("component").agg(F.min("least").alias("component_id"))
    names = tied.join(smallest, "component").select("fp", "component_id")
    return marks.join(names, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one row left of each group: that of the smallest doc_id.

    Of repeated rows with that doc_id one stays. Rows without a doc_id are kept as they are, since
    they cannot be named.
    """
    marks = near_duplicates(docs.select("doc_id", "text"))
    kept = marks.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id IS NULL"))
