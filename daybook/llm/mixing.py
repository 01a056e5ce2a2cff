"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.text import WHITE, stage


@dataclass(frozen=True)
class Curriculum:
    """What a mix aims at.

    ``weights`` go to the sources in order and repeat. A source's weight at time t of training,
    0 to 1, runs on a straight line from ``ramps[i][0]`` to ``ramps[i][1]`` times its mean weight.
    ``demand`` is the size of the mix as a share of all words; ``repeats`` bounds how often a source
    may be used; about ``bucket_rows`` documents of a source are summed in one task.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    ramps: tuple[tuple[float, float], ...] = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
    demand: float = 1.5
    repeats: int = 2
    bucket_rows: int = 2_000


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), WHITE)
    blank_ends = (parts[0] == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - blank_ends).cast("long")


def targets(sources: DataFrame, plan: Curriculum) -> DataFrame:
    """``source, source_size`` with the weight, the schedule and the words to take of each source.

    Sources share the demand by weight. One whose share exceeds ``repeats`` times its size stops
    there, and the excess is shared by weight among the rest until none is above: taken in the order
    of size per weight, the stopped ones come first, and the level of the rest follows from two
    running sums. The table has one row per source, so its windows are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(order) - 1

    def cycled(values: list) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))).cast("int") + 1)

    listed = sources.select(
        "source",
        "source_size",
        cycled(list(plan.weights)).cast("long").alias("weight"),
        cycled([r[0] for r in plan.ramps]).alias("ramp_start"),
        cycled([r[1] for r in plan.ramps]).alias("ramp_end"),
        (plan.repeats * F.col("source_size")).alias("limit"),
    )
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spent = F.coalesce(F.sum("limit").over(before), F.lit(0))
    listed = listed.withColumn("total", F.sum("source_size").over(everything))
    listed = listed.withColumn("left", plan.demand * F.col("total") - spent)
    listed = listed.withColumn("rest", F.sum("weight").over(after))
    open_row = F.col("left") * F.col("weight") / F.col("rest") <= F.col("limit")
    # the level is the one of the first row, in this order, that does not reach its limit
    at_level = F.struct(F.col("limit") / F.col("weight"), "left", "rest")
    level = F.min(F.when(open_row, at_level)).over(everything)
    share = level["left"] * F.col("weight") / level["rest"]
    target = F.least(F.coalesce(share, F.col("limit").cast("double")), F.col("limit").cast("double"))
    return listed.select("source", "source_size", "ramp_start", "ramp_end", target.alias("target"))


def position(demand: Column, target: Column, start: Column, end: Column) -> Column:
    """Time at which a source's cumulative demand reaches ``demand`` words.

    With weight(t) = target * (start + (end - start) t) / mean, the demand up to t is the integral,
    a quadratic; the root is written so that it also holds for a flat schedule.
    """
    share = demand / F.when(target > 0, target)
    mean, slope = (start + end) / 2, end - start
    inside = F.sqrt(F.greatest(start * start + 2 * slope * share * mean, F.lit(0.0)))
    return 2 * share * mean / (start + inside)


def mix(docs: DataFrame, plan: Curriculum = Curriculum(), carried: Column | None = None) -> DataFrame:
    """How often the mix takes each document, and when.

    Returns ``doc_id, source, size, source_size, target, taken, first_position, second_position``
    per row, and ``carried`` where a column of ``docs`` is to travel along. Documents of a source
    queue in the order of the MD5 of their doc_id (of the text, where there is none; then doc_id,
    nulls first, then size), once per epoch; one is taken in an epoch if the middle of its words
    lies within the target, so a source's words miss its target by half a document at most.
    ``taken`` counts words, ``repeats`` times the size at most; positions are times from 0 to 1,
    null where not taken.

    Running sums of a source of any size are taken in buckets of its queue of about ``bucket_rows``
    documents, plus the sums of the buckets before. Null text has size 0 and null source is a
    source of its own; equal rows may be taken in either order; no rows give no rows.
    """
    if plan.repeats != 2:
        raise ValueError("positions are laid out for two epochs")
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit("")).cast("binary"))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mark.alias("mark"))
    if carried is None:
        sized = stage(sized, "sizes")
    else:  # what travels along is read again, not stored twice
        sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mark.alias("mark"), carried.alias("carried"))
    rows = docs.count()
    buckets = max(1, -(-rows // plan.bucket_rows))
    head = F.conv(F.substring("mark", 1, 8), 16, 10).cast("long")
    # the parts of a null-safe key, so that the join below finds the rows where the window has put them
    place = ["named", "nameless", "bucket"]
    sized = sized.withColumns(
        {
            "bucket": F.floor(head * buckets / F.lit(1 << 32)).cast("long"),
            "named": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "nameless": F.col("source").isNull(),
        }
    )
    sums = sized.groupBy("source", *place).agg(F.sum("size").alias("bucket_size"))
    sums = stage(sums, "buckets")
    sources = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), plan)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    offsets = offsets.drop("bucket_size").withColumnRenamed("source", "its_source")
    offsets = offsets.join(
        sources.withColumnRenamed("source", "name"), F.col("its_source").eqNullSafe(F.col("name"))
    ).drop("name", "its_source")
    queue = Window.partitionBy(*place).orderBy(
        F.col("mark"), F.col("doc_id").asc_nulls_first(), "size"
    ).rowsBetween(Window.unboundedPreceding, 0)
    queued = sized.withColumn("up_to", F.sum("size").over(queue)).join(offsets, place)
    middle = F.col("offset") + F.col("up_to") - F.col("size") / 2
    once = (middle <= F.col("target")) & (F.col("size") > 0)
    again = once & (middle + F.col("source_size") <= F.col("target"))
    schedule = (F.col("target"), F.col("ramp_start"), F.col("ramp_end"))
    return queued.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * (once.cast("long") + again.cast("long"))).alias("taken"),
        F.when(once, position(middle, *schedule)).alias("first_position"),
        F.when(again, position(middle + F.col("source_size"), *schedule)).alias("second_position"),
        *(["carried"] if carried is not None else []),
    )


def training_order(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """The documents in training order: one row for each time that the mix takes one.

    All columns of ``docs``, then ``size, source_size, target, taken, epoch, position``; a name that
    ``docs`` has already stays with ``docs`` and the new one gets ``mix_`` in front. Sorted by
    position over ranges. Each row travels whole through the mix and is taken for itself, so rows
    that repeat a doc_id, or have none, are mixed like any other.
    """
    taken = mix(docs, plan, F.struct(*docs.columns))
    both = F.array(
        F.struct(F.lit(1).alias("epoch"), F.col("first_position").alias("position")),
        F.struct(F.lit(2).alias("epoch"), F.col("second_position").alias("position")),
    )
    slots = taken.select("carried", "size", "source_size", "target", "taken", F.inline(F.filter(both, lambda x: x["position"].isNotNull())))
    added = [c for c in slots.columns if c != "carried"]
    named = {c: f"mix_{c}" if c in docs.columns else c for c in added}
    mixed = slots.select("carried.*", *[F.col(c).alias(f"_mix_{c}") for c in added])
    return mixed.orderBy("_mix_position", "doc_id").withColumnsRenamed({f"_mix_{c}": n for c, n in named.items()})
