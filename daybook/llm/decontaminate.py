"""Benchmark decontamination by item-sized windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.text import lower_ascii, stage, words

WIDTH = 5
SIMILARITY = 0.8
# Texts this similar differ in about 10 of 64 bits on average; 23 is more than four deviations up.
RADIUS = 23
BLOCKS = 8
# Sides of at most so many rows are broadcast; larger ones are joined by a shuffle.
SMALL_ROWS = 400_000

#: One bit in each of two 32-bit lanes.
_LANES = 0x0000000100000001


def _side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def _grams(width: str, column: str = "words") -> Column:
    """Every run of ``width`` words of the array, joined by spaces."""
    return F.expr(
        f"transform(sequence(0, size({column}) - {width}), i -> array_join(slice({column}, i + 1, {width}), ' '))"
    )


def _fingerprint(grams: str) -> Column:
    """SimHash of an array of shingles, repeats counted.

    Thirty-two sums hold the counts of two bits each in 32-bit lanes, so an array of any length that
    Spark can hold is counted exactly. Shingles are hashed once.
    """
    hashes = f"transform({grams}, g -> xxhash64(g))"
    lanes = (
        "transform(sequence(0, 31), b -> aggregate(hashes, 0L, "
        f"(s, h) -> s + (shiftrightunsigned(h, b) & {_LANES}L)))"
    )
    bit = f"(shiftrightunsigned(lanes[i % 32], 32 * int(i div 32)) & 4294967295L) * 2 > size({grams})"
    fold = f"aggregate(sequence(0, 63), 0L, (f, i) -> f | if({bit}, shiftleft(1L, i), 0L))"
    return F.expr(f"transform(array({hashes}), hashes -> transform(array({lanes}), lanes -> {fold})[0])[0]")


def _numbered(grams: str) -> Column:
    """Shingles told apart by occurrence, so that set operations on them are weighted.

    Sorted, equal shingles are neighbours; each run of them is numbered from its start.
    """
    starts = "filter(sequence(0, size(s) - 1), i -> NOT (s[i] <=> get(s, i - 1)))"
    runs = (
        "transform(starts, (a, k) -> transform(sequence(1, coalesce(get(starts, k + 1), size(s)) - a), "
        "c -> concat(s[a], ' #', c)))"
    )
    counted = f"transform(array(array_sort({grams})), s -> transform(array({starts}), starts -> flatten({runs}))[0])[0]"
    plain = f"transform({grams}, g -> concat(g, ' #1'))"
    return F.expr(f"if(size(array_distinct({grams})) = size({grams}), {plain}, {counted})")


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``item_id, n, width, grams, fp`` of every item that has a word; ``n`` is its number of words."""
    items = benchmark.select("item_id", words(lower_ascii(F.col("text"))).alias("words")).where(F.size("words") > 0)
    items = items.select("item_id", "words", F.size("words").alias("n"), F.least(F.size("words"), F.lit(WIDTH)).alias("width"))
    # written in between, or the optimiser puts the splitting of a text into the loop over its shingles
    shingled = stage(stage(items, "items").withColumn("grams", _grams("width")), "shingles")
    return shingled.withColumn("fp", _fingerprint("grams"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """``doc_id, text_id, item_id, similarity, start``: items found in documents, with the best window.

    A window has as many words as the item, or all words of a shorter document. It holds an item if
    the weighted Jaccard similarity of their shingles of five lower-cased words (all words of a
    shorter item) is ``similarity`` or more. Windows are found in three steps:

    * A similar window has at least ``similarity`` of the item's shingles, so any choice of one more
      than the item may lack includes one of them. Those beginning with the longest words are looked
      up; only the windows around a hit are fingerprinted, as no other can be similar enough.
    * Their SimHash values meet the items' in a multi-index: with 8 blocks of 8 bits, fingerprints
      within ``radius`` bits differ in at most ``radius // 8`` bits of some block, so each item is
      filed under every such value of each block.
    * The similarity of the pairs within the radius is computed on the shingles themselves.

    Items and documents without words, null texts and empty tables give no rows. Ties go to the first
    window. Rows without a doc_id are searched as well. Repeated items and documents are each reported.
    """
    items = benchmark_items(benchmark)
    flips = [m for m in range(256) if m.bit_count() <= radius // BLOCKS]
    spare = F.expr(f"size(grams) - cast(ceil({similarity} * size(grams) - 1e-9) as int) + 1")
    listed, chosen = items.agg(F.count("*"), F.sum(spare)).first()
    by_length = F.expr(
        "sort_array(transform(grams, (g, i) -> struct(-length(words[i]) AS length, words[i] AS word, g AS gram)))"
    )
    anchors = items.select("n", "width", F.inline(F.slice(by_length, 1, spare))).select("n", "width", "word", "gram")
    anchors = anchors.distinct()

    read = docs.select("doc_id", F.xxhash64("text").alias("text_id"), words(lower_ascii(F.col("text"))).alias("words"))
    at = read.select("doc_id", "text_id", "words", F.posexplode("words").alias("at", "word_here"))
    run = F.expr(f"slice(words, at + 1, {WIDTH})").alias("run")
    if (chosen or 0) > SMALL_ROWS:  # rows are shuffled, so they carry no more than the words they need
        at = at.select("doc_id", "text_id", "at", "word_here", run)
        here = F.expr("array_join(slice(run, 1, width), ' ')")
    else:
        here = F.expr("array_join(slice(words, at + 1, width), ' ')")
    hits = at.join(_side(anchors, chosen or 0), (F.col("word_here") == F.col("word")) & (here == F.col("gram")))
    near = hits.groupBy("doc_id", "text_id", "n", "width").agg(F.collect_set("at").alias("hits"))
    near = stage(near.withColumnRenamed("doc_id", "_doc").withColumnRenamed("text_id", "_text"), "hits")
    same = (F.col("text_id") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    near = read.join(_side(near, near.count()), same).select("doc_id", "text_id", "n", "width", "hits", "words")
    starts = F.expr(
        "array_distinct(flatten(transform(hits, p -> sequence(greatest(0, p - (n - width)), "
        "least(p, greatest(size(words) - n, 0))))))"
    )
    near = near.withColumn("doc_grams", _grams("width")).withColumn("starts", starts)
    seen = "transform(starts, p -> struct(p AS start, slice(doc_grams, p + 1, n - width + 1) AS seen))"
    windows = near.select("doc_id", "text_id", "n", "width", F.expr(f"inline({seen})"))
    windows = windows.withColumn("window_fp", _fingerprint("seen"))

    def blocks(fp: str) -> Column:
        return F.expr(
            f"transform(sequence(0, {BLOCKS - 1}), b -> struct(b AS block, shiftrightunsigned({fp}, 8 * b) & 255 AS value))"
        )

    filed = items.select("item_id", "n", "fp", F.inline(blocks("fp")))
    flip = F.explode(F.array(*[F.lit(m) for m in flips]))
    filed = filed.select("item_id", "n", "fp", "block", "value", flip.alias("flip"))
    filed = filed.select("item_id", "n", "fp", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    looked = windows.select("*", F.inline(blocks("window_fp")))
    met = looked.join(_side(filed, listed * BLOCKS * len(flips)), ["n", "block", "value"])
    # a pair meets in several blocks; the first of them counts
    differing = F.col("fp").bitwiseXOR(F.col("window_fp"))
    earlier = F.expr(
        f"exists(sequence(0, {BLOCKS - 1}), b -> b < block AND "
        f"bit_count(shiftrightunsigned(fp ^ window_fp, 8 * b) & 255) <= {radius // BLOCKS})"
    )
    met = met.where((F.bit_count(differing) <= radius) & ~earlier)
    verified = met.join(_side(items.select("item_id", "grams"), listed), "item_id")
    verified = verified.withColumns({"x": _numbered("seen"), "y": _numbered("grams")})
    verified = verified.withColumn("common", F.size(F.array_intersect("x", "y")))
    verified = verified.withColumn("similarity", F.col("common") / (F.size("x") + F.size("y") - F.col("common")))
    verified = verified.where(F.col("similarity") >= similarity - 1e-9)
    best = F.max_by(F.struct("similarity", "start"), F.struct("similarity", -F.col("start")))
    return verified.groupBy("doc_id", "text_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "text_id", "item_id", "best.similarity", "best.start"
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item.

    Rows are judged by doc_id and text, so a clean one stays though another with its doc_id goes,
    and rows without a doc_id are judged as well. Null texts stay.
    """
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text")).distinct()
    same = (F.xxhash64("text") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    return docs.join(found, same, "left_anti")
