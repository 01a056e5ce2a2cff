"""Line dedup: of documents that have a block of lines in common, the later ones give way.

Hashed runs of lines tell which earlier documents a document has to meet. Each such pair is aligned
by patience diff on the runs, and the aligned blocks are deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.text import FIRST, SECOND, WHITE, stage

# A common block is deleted if it has at least so many words.
BLOCK_WORDS = 10
# Runs of at most so many rows are broadcast; more are joined by a shuffle.
SMALL_ROWS = 400_000


def chains(places: list[int]) -> list[list[int]]:
    """Indices of ``places`` dealt into rising chains, the longest rising subsequence first.

    The first chain is found by patience sorting: each place goes on the first pile whose top is not
    smaller, and remembers the top of the pile before. What is left is moved text: each place
    follows the chain whose end is the nearest below it, which needs the fewest chains.
    """
    tops: list[int] = []
    at_top: list[int] = []
    behind: list[int] = []
    for number, place in enumerate(places):
        at = bisect_left(tops, place)
        tops[at : at + 1] = [place]
        at_top[at : at + 1] = [number]
        behind.append(at_top[at - 1] if at else -1)
    longest, at = [], at_top[-1] if at_top else -1
    while at >= 0:
        longest.append(at)
        at = behind[at]
    found = [longest[::-1]] if longest else []
    used = set(longest)
    ends: list[int] = []  # ascending
    owners: list[list[int]] = []
    for number, place in enumerate(places):
        if number in used:
            continue
        at = bisect_left(ends, place) - 1
        if at < 0:
            owners.insert(0, [number])
            ends.insert(0, place)
            found.append(owners[0])
        else:
            owners[at].append(number)
            ends[at] = place
    return found


def align(anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Aligned blocks ``(start, end, place)`` of a later document with one earlier one.

    ``anchors`` are runs that both have: first line and end in the later one, first line in the
    earlier one. Anchors of a chain that keep their distance and touch form one block.
    """
    longest: dict[tuple[int, int], int] = {}
    for start, end, place in anchors:
        longest[start, place] = max(end, longest.get((start, place), 0))
    ordered = sorted((start, end, place) for (start, place), end in longest.items())
    blocks: list[tuple[int, int, int]] = []
    for chain in chains([place for _, _, place in ordered]):
        start = end = place = -1
        for number in chain:
            s, e, p = ordered[number]
            if start >= 0 and s <= end and p - s == place - start:
                end = max(end, e)
                continue
            if start >= 0:
                blocks.append((start, end, place))
            start, end, place = s, e, p
        blocks.append((start, end, place))
    return blocks


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _run_ends(sizes: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest runs of ``least`` words from each line on and up to each line.

    ``sizes`` are the words of the lines of several documents, ``first`` the first line of each and
    the end; no run crosses documents.
    """
    sums = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ends = np.searchsorted(sums, sums[:-1] + least)
    onward = ends <= first[owner + 1]
    starts = np.searchsorted(sums, sums[1:] - least, side="right") - 1
    back = (sums[1:] >= least) & (starts >= first[owner])
    spans = np.concatenate(
        [np.stack([at[onward], ends[onward]], axis=1), np.stack([starts[back], at[back] + 1], axis=1)]
    )
    spans = np.unique(spans, axis=0)
    return spans[:, 0], spans[:, 1]


def _runs(docs: DataFrame, block_words: int) -> DataFrame:
    """``doc_id, text_id, start, end, run, check``: the shortest runs of lines with ``block_words`` words.

    ``run`` and ``check`` are 128 bits of hash of the lines.
    """
    held = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    held = held.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_id"), _lines(F.col("text")).alias("lines"))
    hashes = F.transform("lines", lambda x: F.xxhash64(x))
    checks = F.transform("lines", lambda x: F.xxhash64(F.lit("again"), x))
    sizes = F.transform("lines", lambda x: F.size(F.filter(F.split(x, WHITE), lambda w: w != "")))
    held = held.select("doc_id", "text_id", hashes.alias("lines"), checks.alias("checks"), sizes.alias("sizes"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, checks, sizes = (batch.column(c).flatten().to_numpy() for c in ("lines", "checks", "sizes"))
            counts = batch.column("lines").value_lengths().to_numpy()
            first = np.concatenate([[0], np.cumsum(counts)])
            starts, ends = _run_ends(sizes, first, block_words)
            owner = np.searchsorted(first, starts, side="right") - 1
            columns = [
                batch.column("doc_id").take(pa.array(owner)),
                batch.column("text_id").take(pa.array(owner)),
                pa.array((starts - first[owner]).astype(np.int32)),
                pa.array((ends - first[owner]).astype(np.int32)),
                pa.array(FIRST.spans(lines.view(np.uint64), starts, ends).view(np.int64)),
                pa.array(SECOND.spans(checks.view(np.uint64), starts, ends).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_id", "start", "end", "run", "check"])

    return held.mapInArrow(run, "doc_id long, text_id long, start int, end int, run long, check long")


def alignments(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, text_id, earlier, blocks``: pairs of documents with the blocks aligned between them.

    A block is a run of consecutive lines of ``block_words`` words or more that both documents have;
    ``blocks`` are ``start, end, place``: line numbers from 0 in the later document, end exclusive,
    and the first line in the earlier one.

    * Every line of a block lies in the shortest run of so many words from it on, or else in the
      shortest one up to the end of the block, and both lie in the block. So the runs that some
      earlier document has cover exactly the blocks, short and repeated lines included.
    * Each run leads to the earliest document that has it, and there to one of its places: a
      partner stands for all other holders, and the rows are linear in lines whatever the size of a group.
    * A document is aligned with each of its partners by patience diff, the runs being the anchors;
      what moved is aligned in further chains, so every shared run ends up in a block.

    Pairs are dealt by document and partner, so one that meets many partners is many small groups.
    """
    runs = _runs(docs, block_words)
    first = runs.groupBy("run", "check").agg(
        F.min("doc_id").alias("earlier"), F.min_by("start", "doc_id").alias("place"), F.max("doc_id").alias("last")
    )
    first = stage(first.where("earlier < last").drop("last"), "runs")
    few = F.broadcast(first) if first.count() <= SMALL_ROWS else first
    found = runs.join(few, ["run", "check"]).where("earlier < doc_id")
    anchors = found.groupBy("doc_id", "text_id", "earlier").agg(F.collect_set(F.struct("start", "end", "place")).alias("anchors"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "place")]))
        for batch in batches:
            aligned = [
                [{"start": s, "end": e, "place": p} for s, e, p in align([(a["start"], a["end"], a["place"]) for a in own])]
                for own in batch.column("anchors").to_pylist()
            ]
            columns = [batch.column(c) for c in ("doc_id", "text_id", "earlier")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(aligned, kind)], ["doc_id", "text_id", "earlier", "blocks"])

    block = "array<struct<start: int, end: int, place: int>>"
    return anchors.mapInArrow(run, f"doc_id long, text_id long, earlier long, blocks {block}")


def overlaps(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, text_id, partners, spans``: the lines of each document that its alignments delete.

    ``partners`` counts the earlier documents it is aligned with. Spans are line numbers from 0, end
    exclusive, disjoint and in order.
    """
    pairs = alignments(docs, block_words)
    found = pairs.groupBy("doc_id", "text_id").agg(
        F.count("*").alias("partners"), F.flatten(F.collect_list("blocks")).alias("spans")
    )

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for spans in batch.column("spans").to_pylist():
                own: list[dict] = []
                for span in sorted(spans, key=lambda s: s["start"]):
                    if own and span["start"] <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], span["end"])
                    else:
                        own.append({"start": span["start"], "end": span["end"]})
                merged.append(own)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [batch.column(c) for c in ("doc_id", "text_id", "partners")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(merged, kind)], ["doc_id", "text_id", "partners", "spans"])

    return found.mapInArrow(
        merge, "doc_id long, text_id long, partners long, spans array<struct<start: int, end: int>>"
    )


def line_dedup(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with the lines deleted that an earlier document has in a block; see ``overlaps``.

    Returns all columns of ``docs`` with ``text`` cut, then ``n_lines, n_removed, n_partners``; a name
    that ``docs`` has already gets ``line_`` in front. Blocks of fewer than ``block_words`` words stay.
    A text without a repeat is unchanged, one that is all repeats becomes empty; null text stays null
    with 0 lines. Rows without a doc_id are neither earlier nor later than others and stay as they are;
    rows with the same doc_id give way only to smaller ones. No rows give no rows.
    """
    spans = overlaps(docs, block_words)
    names = {c: f"line_{c}" if c in docs.columns else c for c in ("n_lines", "n_removed", "n_partners")}
    found = spans.select(
        F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text"), F.col("spans").alias("_spans"), F.col("partners").alias("_partners")
    )
    same = (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_text"))
    lines = _lines(F.col("text"))
    kept = F.filter(
        lines, lambda x, i: ~F.exists("_spans", lambda s: (i >= s["start"]) & (i < s["end"]))
    )
    joined = docs.join(found, same, "left")
    cut = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    gone = F.coalesce(F.size(lines) - F.size(kept), F.lit(0))
    counts = {
        names["n_lines"]: F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)),
        names["n_removed"]: F.when(F.col("_spans").isNull(), 0).otherwise(gone),
        names["n_partners"]: F.coalesce("_partners", F.lit(0)),
    }
    return joined.select(
        *[cut.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        *[value.cast("long").alias(name) for name, value in counts.items()],
    )
