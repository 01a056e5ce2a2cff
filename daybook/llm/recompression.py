"""Substring dedup: recompression names runs and pairs of words, shared names lead to long repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.text import FIRST, SECOND, as_bytes, find_words, mix, slices, stage

WINDOW = 50
ROUNDS = 9


class Parse:
    """Symbols of word sequences, level by level, and what of them every occurrence of a window has.

    Level 0 has a symbol per word, level 1 one per maximal run of a word. Each further level joins
    two neighbours x, y into a symbol where a bit of the name of x is 0 and that of y is 1, so whether
    a gap closes depends on the two symbols beside it alone; names are hashes of what they stand for,
    the same in every document and task. For a start s and an end e, ``left[s]`` and ``right[e]``
    bound the boundaries that all occurrences of the words from s to e share at the level: one that
    depends on a symbol outside is passed over. The symbol at ``left[s]`` of the highest level at
    which ``left[s] < right[e]`` is thus named alike wherever these words occur.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, window: int, rounds: int) -> None:
        n = len(words)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        whole = np.flatnonzero(np.diff(first) >= window)
        spans = [np.arange(first[d], first[d + 1] - window + 1) for d in whole]
        self.starts = np.concatenate([np.empty(0, np.int64), *spans]).astype(np.int64)
        self.owner = owner[self.starts] if n else np.empty(0, np.int64)
        left, right = self.starts.copy(), self.starts + window
        self.names = mix(words[left]) if n else np.empty(0, np.uint64)
        if not len(left):
            return
        # runs of a word within a text
        new = np.ones(n + 1, bool)
        new[1:n] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        cuts, lengths = at[:-1], np.diff(at)
        symbols = mix(words[cuts] + np.uint64(0x9E3779B97F4A7C15) * lengths.astype(np.uint64))
        belongs = owner[cuts]
        run_of = np.searchsorted(at, np.arange(n), "right") - 1
        left = at[run_of[left] + 1]
        right = cuts[run_of[right - 1]]
        # left and right hold boundaries, kept from here on as numbers of symbols
        left, right = np.searchsorted(at, left), np.searchsorted(at, right)
        for level in range(rounds):
            inside = left < right
            if not inside.any():
                break
            self.names[inside] = symbols[left[inside]]
            if level == rounds - 1:
                break
            upper = (mix(symbols ^ np.uint64(level + 1)) & np.uint64(1)).astype(bool)
            joins = np.zeros(len(symbols), bool)  # whether a symbol joins the one before it
            joins[1:] = ~upper[:-1] & upper[1:] & (belongs[1:] == belongs[:-1])
            # a first symbol that may join to the left is passed over, and so is a last one to the right
            bits = np.append(upper, False)
            left = np.where(inside, left + bits[left], 0)
            right = np.where(inside, right - ~bits[right - 1], 0)
            heads = np.flatnonzero(~joins)
            number = np.append(np.cumsum(~joins) - 1, len(heads))
            paired = np.append(joins[1:], False)[heads]
            follow = symbols[np.minimum(heads + 1, len(symbols) - 1)]
            joined = mix(symbols[heads] * np.uint64(0xD6E8FEB86659FD93) + (follow ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            symbols, belongs = np.where(paired, joined, symbols[heads]), belongs[heads]
            left, right = number[left], number[right]


def _first_of_each(owner: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of text and name, by text."""
    if not len(owner):
        return owner, names
    change = np.ones(len(owner), bool)
    change[1:] = (owner[1:] != owner[:-1]) | (names[1:] != names[:-1])
    owner, names = owner[change], names[change]
    order = np.lexsort([names, owner])
    owner, names = owner[order], names[order]
    change = np.ones(len(owner), bool)
    change[1:] = (owner[1:] != owner[:-1]) | (names[1:] != names[:-1])
    return owner[change], names[change]


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def summaries(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """``doc_id, mark, n_words, sha, names`` per row: number and digest of the words, and the names
    of the symbols that stand for its windows, each once. ``mark``, 32 bits of hash to keep the
    shuffled rows short, tells texts of one doc_id apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            found = find_words(as_bytes(piece.column("text")))
            parse = Parse(FIRST.words(found), found.first, window, rounds)
            owner, names = _first_of_each(parse.owner, parse.names)
            digests = [_digest(found.buffer[a:b].split()) for a, b in _bounds(found)]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    piece.column("mark"),
                    pa.array(found.counts.astype(np.int64)),
                    pa.array(digests, pa.binary()),
                    _lists(owner, names, piece.num_rows),
                ],
                ["doc_id", "mark", "n_words", "sha", "names"],
            )

    return docs.mapInArrow(run, "doc_id long, mark int, n_words long, sha binary, names array<long>")


def _digest(found: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(found)).digest()


def _bounds(found) -> list[tuple[int, int]]:
    """Byte span of the words of every text; an empty one without words."""
    return [
        (found.starts[a], found.ends[b - 1]) if b > a else (0, 0) for a, b in zip(found.first[:-1], found.first[1:])
    ]


def _windows(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """``doc_id, mark, at, x, y``: windows that a shared name stands for, with 128 bits of hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            found = find_words(as_bytes(piece.column("text")))
            one, two = FIRST.words(found), SECOND.words(found)
            parse = Parse(one, found.first, window, rounds)
            shared = piece.column("names")
            sizes = np.diff(shared.offsets.to_numpy())
            theirs = shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            salt = mix(np.arange(piece.num_rows, dtype=np.uint64) + np.uint64(77))
            wanted = np.isin(parse.names ^ salt[parse.owner], theirs ^ np.repeat(salt, sizes))
            starts, owner = parse.starts[wanted], parse.owner[wanted]
            columns = [
                pa.array(piece.column("doc_id").to_numpy()[owner]),
                pa.array(piece.column("mark").to_numpy()[owner]),
                pa.array((starts - found.first[:-1][owner]).astype(np.int32)),
                pa.array(FIRST.spans(one, starts, starts + window).view(np.int64)),
                pa.array(SECOND.spans(two, starts, starts + window).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "at", "x", "y"])

    return docs.mapInArrow(run, "doc_id long, mark int, at int, x long, y long")


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, mark, n_removed, sha, kept``: texts without the words of the windows at ``found``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            gone, texts = [], []
            for text, found in zip(as_bytes(piece.column("text")), piece.column("found")):
                own = text.split()
                at = np.array(found.values, np.int64)
                depth = np.zeros(len(own) + 1, np.int64)
                np.add.at(depth, at, 1)
                np.add.at(depth, at + window, -1)
                kept = np.cumsum(depth)[:-1] == 0
                gone.append(len(own) - int(kept.sum()))
                texts.append(b" ".join([w for w, k in zip(own, kept) if k]))
            digests = [hashlib.sha256(t).digest() for t in texts]
            columns = [piece.column("doc_id"), piece.column("mark"), pa.array(gone, pa.int64()), pa.array(digests, pa.binary())]
            kept_text = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, kept_text], ["doc_id", "mark", "n_removed", "sha", "kept"])

    return docs.mapInArrow(run, "doc_id long, mark int, n_removed long, sha binary, kept string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept``: words left when repeats of earlier texts go.

    A word goes if a window of ``window`` words that covers it also starts in a document with a
    smaller doc_id, both as in the input. ``kept`` is the remaining text if some of it went and it
    is not a whole copy, else null. The steps:

    * Recompression gives every window a name that all its occurrences share. Of equal word
      sequences the one with the smallest doc_id stands for all; every other one is a whole copy
      and goes at once if it fills a window.
    * Names that two doc_ids share lead to the documents, and there to the windows, that may repeat.
    * Those windows are compared by 128 bits of hash; the smallest doc_id of each keeps it.

    Hot names and windows are pre-aggregated before the shuffle, and the joins back to them have a
    row per occurrence, which Spark splits when a key is large. Null text has no words. Rows without
    a doc_id are compared with none; rows of the same doc_id do not remove each other. One row per
    input row; no rows give no rows.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("mark"))
    found = stage(summaries(marked, window, rounds), "summaries")
    firsts = found.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("least"))
    told = found.select("doc_id", "mark", "n_words", "sha").join(firsts, "sha", "left")
    told = stage(told.withColumn("whole", F.coalesce((F.col("least") < F.col("doc_id")) & (F.col("n_words") >= window), F.lit(False))), "copies")

    used = told.where("NOT whole AND doc_id IS NOT NULL").select("doc_id", "mark").distinct()
    names = found.join(used, ["doc_id", "mark"]).select("doc_id", "mark", F.explode("names").alias("name"))
    shared = names.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = shared.where("low < high").select("name")
    mine = names.join(shared, "name").groupBy("doc_id", "mark").agg(F.collect_set("name").alias("names"))
    hopeful = stage(marked.join(mine, ["doc_id", "mark"]), "hopeful")

    windows = _windows(hopeful, window, rounds)
    lowest = windows.groupBy("x", "y").agg(F.min("doc_id").alias("low"))
    late = windows.join(lowest, ["x", "y"]).where("low < doc_id")
    late = late.groupBy("doc_id", "mark").agg(F.collect_set("at").alias("found"))
    cut = _cut(hopeful.drop("names").dropDuplicates(["doc_id", "mark"]).join(late, ["doc_id", "mark"]), window)
    cut = cut.withColumnRenamed("sha", "cut_sha")

    out = told.join(cut, ["doc_id", "mark"], "left")
    empty = F.lit(hashlib.sha256(b"").digest())
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.lower(F.hex(F.when(F.col("whole"), empty).otherwise(F.coalesce("cut_sha", "sha")))).alias("kept_sha256"),
        "kept",
    )
