"""Merkle manifest of a corpus: one tree per source, one tree over the sources.

Per level, columns of fixed lag and lead supply the siblings of every node: the lag of ``k`` counts
where the slot in the run is at least ``k``, the lead of ``k`` where slot and ``k`` stay below the
run's length. The first child of a run hashes the parent. Texts are hashed where they are read;
only digests are shuffled. Windows hold ``RUNS`` runs, never a whole source, so a source of any
size is spread over many tasks; what grows on the driver is the number of levels.

Nulls count as ``-`` in a leaf; a null source is a source of its own, before all others. Leaves of
a source ascend by doc_id, null first; rows that share a doc_id by their leaf. Repeated rows are
leaves of their own. An empty table has no rows and no root. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.numbering import numbered
from daybook.llm.text import lower_ascii, stage

ARITY = 16
#: Runs of one window partition.
RUNS = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
KEY = ["_known", "_source"]
ALL = ["_all"]


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in front, so that no two rows read alike; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Digest of a document, with some of its columns replaced."""
    return digest(*[field(changed.get(name, F.col(name))) for name in FIELDS])


def _siblings(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Nodes (key, position, size, node) with the digests ``left`` and ``right`` of them in their run."""
    chunk = F.floor(F.col("position") / (ARITY * RUNS))
    row = Window.partitionBy(*key, chunk).orderBy("position")
    slot = F.col("position") % ARITY
    length = F.least(F.lit(ARITY), F.col("size") - (F.col("position") - slot))
    lags = [F.when(slot >= k, F.lag("node", k).over(row)) for k in range(ARITY - 1, 0, -1)]
    leads = [F.when(slot + k < length, F.lead("node", k).over(row)) for k in range(1, ARITY)]
    return nodes.withColumns({"left": F.concat_ws("", *lags), "right": F.concat_ws("", *leads)})


def _parents(nodes: DataFrame, key: list[str]) -> DataFrame:
    """One node per run, made by its first child; ``size`` is that of the new level."""
    first = nodes.where((F.col("position") % ARITY == 0) & (F.col("size") > 1))
    return first.select(
        *key,
        (F.col("position") / ARITY).cast("long").alias("position"),
        F.ceil(F.col("size") / ARITY).cast("long").alias("size"),
        digest("node", "right").alias("node"),
    )


def _climb(rows: DataFrame, key: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels above the rows, with siblings, and the last node of each tree with its ``level``."""
    largest = rows.agg(F.max("size")).first()[0] or 0
    levels, tops = [], rows.where("size = 1").select(*key, "node", F.lit(0).alias("level"))
    below = _siblings(rows.select(*key, "position", "size", "node"), key)
    while largest > 1:
        below = stage(_siblings(_parents(below, key), key), f"{name}-{len(levels) + 1}")
        levels.append(below)
        tops = tops.union(below.where("size = 1").select(*key, "node", F.lit(len(levels)).alias("level")))
        largest = -(-largest // ARITY)
    return levels, tops


def _descend(rows: DataFrame, levels: list[DataFrame], tops: DataFrame, key: list[str], name: str) -> DataFrame:
    """Rows with ``path`` (siblings of every level, lowest first, then that of ``tops``) and the columns of tops."""
    given = [c for c in tops.columns if c not in (*key, "level", "path")]
    known = None
    for number in range(len(levels), -1, -1):
        nodes = levels[number - 1] if number else _siblings(rows, key)
        alone = nodes.where("size = 1").drop("left", "right")
        found = alone.join(tops.where(F.col("level") == number).drop("level"), key)
        if known is not None:
            above = known.select(*key, F.col("position").alias("_run"), *given, F.col("path").alias("_path"))
            many = nodes.where("size > 1").withColumn("_run", (F.col("position") / ARITY).cast("long"))
            step = F.array(F.struct("left", "right"))
            joined = many.join(above, [*key, "_run"]).withColumn("path", F.concat(step, "_path"))
            found = joined.select(*found.columns).union(found)
        if not number:
            return found
        known = stage(found.select(*key, "position", *given, "path"), f"{name}-path-{number}")
    raise AssertionError("unreachable")


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, node, lambda made, step: digest(step["left"], made, step["right"]))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(docs: DataFrame, found_leaf: Column | None = None) -> DataFrame:
    """Every document's doc_id, leaf, subroot, root, and path: siblings level by level.

    ``found_leaf``, an expression over the documents, is the leaf of the row as it was found later;
    where it is null or not given, the leaf itself. ``fold`` of it and the path must give the root.
    """
    hashed = docs.select(
        "doc_id",
        F.col("source").isNotNull().alias(KEY[0]),
        F.coalesce("source", F.lit("")).alias(KEY[1]),
        leaf().alias("node"),
        (F.lit(None).cast("string") if found_leaf is None else found_leaf).alias("found_leaf"),
    )
    rows = numbered(hashed, KEY, [F.col("doc_id"), F.col("node")], "leaves")
    levels, tops = _climb(rows, KEY, "tree")
    sources = numbered(tops.withColumn(ALL[0], F.lit(True)), ALL, [F.col(c) for c in KEY], "subroots")
    high, last = _climb(sources, ALL, "sources")
    last = last.select(*ALL, "level", F.col("node").alias("root"), _no_path())
    above = _descend(sources.withColumnRenamed("level", "_level"), high, last, ALL, "sources")
    joined = above.select(*KEY, F.col("_level").alias("level"), F.col("node").alias("subroot"), "root", "path")
    placed = _descend(rows, levels, stage(joined, "subroot-paths"), KEY, "tree")
    found = F.coalesce("found_leaf", "node").alias("found_leaf")
    return placed.select("doc_id", F.col("node").alias("leaf"), found, "subroot", "root", "path")


def _no_path() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>").alias("path")


def verify(docs: DataFrame, tampered: Column) -> DataFrame:
    """The manifest tried on rows whose text had its A to Z lower-cased where ``tampered`` holds.

    ``folded_root`` comes from the leaf as found and the siblings of the manifest.
    """
    lowered = leaf(text=lower_ascii(F.col("text")))
    rows = manifest(docs, F.when(tampered & F.col("text").isNotNull(), lowered))
    folded = rows.withColumn("folded_root", fold(F.col("found_leaf"), F.col("path")))
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    evidence = F.sha2(proof(F.col("path")).cast("binary"), 256).alias("proof_sha256")
    return folded.select("doc_id", "leaf", "subroot", "root", evidence, "folded_root", verified)
