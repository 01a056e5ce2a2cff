"""Near copies by exact similarity of five-word shingles, on request beyond the radius of SimHash fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm import simhash
from daybook.llm.components import components
from daybook.llm.text import as_bytes, slices, stage
from daybook.session import discard

WIDTH = 5
SIMILARITY = 0.8
# One text in so many is looked up for common shingles; the order of shingles changes no result. A fixed
# share finds keys from the same number of members on, whatever the number of texts.
SHARE = 10
# Common shingles every task knows: 16 MB.
COMMON = 1_000_000
# Keys of at most so many members are compared in all pairs at once.
SMALL_KEY = 16
# Rounds in which one member of each larger key meets all others, before what is left is compared.
ROUNDS = 3
# Members of a key in one piece of the comparison of what is left.
BLOCK = 1024
# Cells of the sketch of a set, one byte each.
CELLS = 256
# Sides of at most so many rows are broadcast; larger ones are joined by a shuffle.
SMALL_ROWS = 400_000


def _side(df: DataFrame) -> DataFrame:
    """``df``, already stored, to be broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _grams(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` lower-cased words; a shorter text is one."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    cuts = [0]
    for word in found:
        cuts.append(cuts[-1] + len(word) + 1)
    spans = zip(cuts, cuts[width:]) if len(found) > width else [(0, len(joined) + 1)]
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a : b - 1], 42) for a, b in spans], np.uint64))


def _named(grams: np.ndarray) -> int:
    """Name of a set of shingles."""
    return xxhash.xxh3_64_intdigest(grams.tobytes(), 5)


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sampled texts hold, sorted, and how many hold each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            found = [_grams(t, width) for t in as_bytes(piece.column("text"))]
            flat = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat)], ["gram"])

    some = docs.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(SHARE)) == 0).select("text").mapInArrow(run, "gram long")
    held = some.groupBy("gram").count().where("count > 2").orderBy(F.desc("count"), "gram").limit(COMMON).toArrow()
    grams = held.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(grams)
    return grams[order], held.column("count").to_numpy()[order]


def _marks(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """``doc_id, text_id, s, n, prefix``: each text's set of shingles, its size and its rarest shingles.

    Two sets of the similarity share at least ``ceil(similarity * n)`` of the ``n`` shingles of either,
    so that in any order that all texts have in common each has a shared one among its first
    ``n - ceil(similarity * n) + 1``. The order puts shingles that are common in a sample last.
    """
    common, held = _common(docs, width)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            names, sizes, firsts = [], [], []
            for text in as_bytes(piece.column("text")):
                grams = _grams(text, width)
                ranks = np.zeros(len(grams), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
                    ranks = np.where(common[at] == grams, held[at], 0)
                lead = len(grams) - ceil(similarity * len(grams) - 1e-9) + 1 if len(grams) else 0
                names.append(_named(grams))
                sizes.append(len(grams))
                firsts.append(grams[np.lexsort((grams, ranks))[:lead]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    piece.column("text_id"),
                    pa.array(np.array(names, np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int32()),
                    pa.array(firsts, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_id", "s", "n", "prefix"],
            )

    return docs.mapInArrow(run, "doc_id long, text_id long, s long, n int, prefix array<long>")


def _sets(docs: DataFrame, names: DataFrame, used: DataFrame, width: int, repeated: bool) -> DataFrame:
    """``s, size, sketch, grams`` of the sets in ``used``, each read from one text that has it.

    The sketch counts the shingles by their hash modulo ``CELLS``, up to 255. With ``repeated`` rows
    (doc_id and text alike) one of them is taken, which shuffles the texts.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            found = [_grams(t, width) for t in as_bytes(piece.column("text"))]
            counts = [np.bincount((g % np.uint64(CELLS)).astype(np.int64), minlength=CELLS) for g in found]
            sketches = [np.minimum(c, 255).astype(np.uint8).tobytes() for c in counts]
            columns = [
                piece.column("s"),
                pa.array([len(g) for g in found], pa.int32()),
                pa.array(sketches, pa.binary()),
                pa.array([g.view(np.int64) for g in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["s", "size", "sketch", "grams"])

    chosen = stage(names.join(used, "s").select("s", F.col("text_id").alias("_text"), F.col("doc_id").alias("_doc")), "chosen")
    one = (F.col("text_id") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    texts = docs.join(_side(chosen), one).select("s", "text")
    texts = texts.dropDuplicates(["s"]) if repeated else texts
    return stage(texts.mapInArrow(read, "s long, size int, sketch binary, grams array<long>"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose sets have the similarity.

    Two sets share at most the sum of the lesser counts of their sketches, so most pairs that are
    not alike go before any whole set is sent.
    """

    def bound(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CELLS) for c in ("x", "y")
            ]
            both = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            full = (x == 255).any(axis=1) | (y == 255).any(axis=1)
            total = batch.column("n").to_numpy().astype(np.int64) + batch.column("m").to_numpy()
            near = full | (both >= similarity / (1 + similarity) * total - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def sides(of: DataFrame, held: DataFrame, column: str) -> DataFrame:
        left = held.select(F.col("s").alias("a"), F.col("size").alias("n"), F.col(column).alias("x"))
        right = held.select(F.col("s").alias("b"), F.col("size").alias("m"), F.col(column).alias("y"))
        return of.join(left, "a").join(right, "b")

    likely = stage(sides(pairs, sets, "sketch").mapInArrow(bound, "a long, b long"), "likely")
    used = stage(likely.select(F.explode(F.array("a", "b")).alias("s")).distinct(), "used")
    return sides(likely, sets.join(_side(used), "s"), "grams").mapInArrow(compare, "a long, b long")


def _possible(similarity: float) -> Column:
    """Whether sizes and places in the order leave room for the similarity."""
    shared = F.least("i", "j") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    return shared >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-9


def _other(keyed: DataFrame, *also: str) -> DataFrame:
    """Members of keys as the second side of a pair."""
    return keyed.select("k", *also, F.col("s").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"))


def _across(tied: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members ``s, n, i`` and ``b, m, j`` of each key that lie in different components, in pieces of the key."""
    cut = tied.join(sizes.select("k", F.ceil(F.col("members") / BLOCK).cast("int").alias("parts")), "k")
    cut = cut.withColumn("part", F.pmod(F.xxhash64("s", F.lit(7)), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = cut.select("k", "s", "n", "i", "component", F.col("part").alias("x"), every.alias("y"))
    right = _other(cut.select("*", F.col("part").alias("y"), every.alias("x")), "x", "y", "component")
    right = right.withColumnRenamed("component", "its")
    return left.join(right, ["k", "x", "y"]).where(F.col("component") < F.col("its"))


def _fingerprint_links(read: DataFrame, marks: DataFrame) -> DataFrame:
    """``a, b``: links among the sets of shingles whose texts have SimHash fingerprints in the radius.

    A set stands for all texts that have it. Each set links to the least set of each of its
    fingerprints, and the least sets of near fingerprints link to each other.
    """
    prints = simhash.fingerprints(read.select(F.col("text_id").alias("doc_id"), "text"))
    named = marks.select("text_id", "s").distinct()
    held = prints.withColumnRenamed("doc_id", "text_id").distinct().join(named, "text_id").select("fp", "s").distinct()
    held = stage(held, "prints")
    least = stage(held.groupBy("fp").agg(F.min("s").alias("least")), "fingerprints")
    same = held.join(least, "fp").where("s <> least").select(F.col("least").alias("a"), F.col("s").alias("b"))
    found = simhash.near_links(least.select("fp"))
    ends = [least.select(F.col("fp").alias(c), F.col("least").alias(f"s_{c}")) for c in "ab"]
    near = found.join(ends[0], "a").join(ends[1], "b").where("s_a <> s_b")
    return stage(same.unionByName(near.select(F.col("s_a").alias("a"), F.col("s_b").alias("b"))), "alike")


def groups(
    docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, fingerprints: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_id, s`` of every row, and ``s, component`` of the sets that link to others.

    With ``fingerprints`` texts link if their SimHash fingerprints lie in the radius of ``simhash``. Beyond
    it, or without, texts link if the Jaccard similarity of their sets of shingles is ``similarity`` or more;
    texts without words are all alike. Every pair of the similarity shares a key of the prefix filter. Keys of few
    members are compared in all pairs. In each larger one a member meets all others, round by round;
    members of one component need no comparison any more, so a group of near copies takes pairs
    linear in its size. After the rounds, all pairs that still lie in different components are compared.
    """
    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_id"), "text")
    marks = stage(_marks(read, width, similarity), "marks")
    least = F.min(F.struct("text_id", "doc_id"))
    names = marks.groupBy("s").agg(least.alias("one")).select("s", "one.text_id", "one.doc_id")
    keyed = marks.select("s", "n", F.posexplode("prefix").alias("i", "k"))
    ends = keyed.groupBy("k").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    shared = stage(ends.where("low < high").select("k"), "shared")
    met = stage(keyed.join(_side(shared), "k").distinct(), "keys")
    repeated = not marks.groupBy("doc_id", "text_id").count().where("count > 1").isEmpty()
    sets = _sets(read, names, met.select("s").distinct(), width, repeated)
    sizes = stage(met.groupBy("k").agg(F.count("*").alias("members")), "members")

    def near(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where(_possible(similarity)).select(F.least("s", "b").alias("a"), F.greatest("s", "b").alias("b"))
        return stage(_verified(stage(pairs.distinct(), "pairs"), sets, similarity), "near")

    few = met.join(_side(sizes.where(F.col("members") <= SMALL_KEY).select("k")), "k")
    if fingerprints:
        alike = components(_fingerprint_links(read, marks))
        few = few.join(alike.withColumnRenamed("node", "s"), "s", "left").withColumn("component", F.coalesce("component", "s"))
        apart = few.join(_other(few, "component").withColumnRenamed("component", "its"), "k").where("component <> its")
        found = near(apart.where("s < b"))
        links = components(alike.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
    else:
        links = components(near(few.join(_other(few), "k").where("s < b")))
    large = met.join(_side(sizes.where(F.col("members") > SMALL_KEY).select("k")), "k")
    for number in range(ROUNDS + 1):
        tied = large.join(links.withColumnRenamed("node", "s"), "s", "left")
        tied = stage(tied.withColumn("component", F.coalesce("component", "s")), "tied")
        ends = tied.groupBy("k").agg(
            F.count("*").alias("members"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.min(F.struct("s", "n", "i", "component")).alias("hub"),
        )
        unlike = stage(ends.where("low < high").select("k", "members", "hub"), "unlike")
        if unlike.isEmpty():
            break
        if number < ROUNDS:
            hub = [F.col(f"hub.{c}").alias(name) for c, name in zip(("s", "n", "i", "component"), ("b", "m", "j", "its"))]
            rest = tied.join(_side(unlike.select("k", *hub)), "k").where(F.col("s") > F.col("b"))
            found = near(rest.where("component <> its"))
            large = rest.select("k", "s", "n", "i")
        else:
            found = near(_across(tied, unlike))
        if not found.isEmpty():
            links = components(links.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
    discard(sets)  # longer than the texts, and all pairs have been verified
    return marks.select("doc_id", "text_id", "s"), links.withColumnRenamed("node", "s")


def keep_one(
    docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, fingerprints: bool = False
) -> DataFrame:
    """The documents with one row left of each group of near copies: that of the smallest doc_id.

    Of repeated rows with that doc_id and text one stays. Rows without a doc_id are kept as they are,
    since they cannot be named.
    """
    marks, tied = groups(docs, width, similarity, fingerprints)
    least = marks.where("doc_id IS NOT NULL").groupBy("s").agg(F.min(F.struct("doc_id", "text_id")).alias("least"))
    least = least.join(tied, "s", "left").groupBy(F.coalesce("component", "s")).agg(F.min("least").alias("least"))
    kept = least.select(F.col("least.doc_id").alias("_doc"), F.col("least.text_id").alias("_text"))
    here = (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_text"))
    named = docs.join(kept, here, "left_semi").withColumn("_text", F.xxhash64("text"))
    named = named.dropDuplicates(["doc_id", "_text"]).drop("_text")
    return named.unionByName(docs.where("doc_id IS NULL"))
