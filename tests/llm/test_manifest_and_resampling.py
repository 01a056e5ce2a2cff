"""Merkle manifest and importance resampling against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from daybook.llm import merkle, resampling
from daybook.llm.queries import remainder

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = "The of And To É中 a1 it".split()

    def text(n):
        return " ".join(rng.choice(words) + rng.choice("abcd") for _ in range(n))

    rows = [(i, text(rng.randint(0, 60)), "en", "hot" if i % 3 else f"s{i % 21}", i) for i in range(420)]
    rows += [(1000, None, None, None, None), (1001, "", "de", None, 0), (1002, text(9000), None, "alone", 7)]
    rows += [(None, "No id Here " * 9, "en", "hot", 1), (1003, " \x00 -- ", "en", "Ä", 2)]
    rows += [rows[5], rows[5], (7, "Same id, other text " * 8, "en", "hot", 3)]
    return rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    """Root and for every node the (left, right) siblings on its path."""
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        made, over = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for j in range(len(run)):
                for leaf in below[a + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            made.append(sha("".join(run)))
            over.append(sum(below[a : a + 16], []))
        nodes, below = made, over
    return nodes[0], paths


def expected_manifest(corpus):
    def leaf(doc, text, lang, source, n):
        values = [doc, source, lang, n, text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    sources = defaultdict(list)
    for doc, text, *rest in corpus:
        other = leaf(doc, text and text.translate(LOW), *rest)
        sources[rest[1]].append((-1 if doc is None else doc, leaf(doc, text, *rest), other, doc))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        sources[name].sort(key=lambda r: r[:2])
    trees = [tree([r[1] for r in sources[name]]) for name in names]
    root, high = tree([t[0] for t in trees])
    rows = []
    for name, (subroot, paths), above in zip(names, trees, high):
        for (_, own, other, doc), path in zip(sources[name], paths):
            node = other if zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 0 else own
            for left, right in path + above:
                node = sha(left + node + right)
            proof = sha("".join(a + b for a, b in path + above))
            rows.append((doc, own, subroot, root, proof, node, node == root))
    return rows


def test_manifest_equals_brute_force(spark, corpus):
    docs = spark.createDataFrame(corpus, DOC).withColumns({"size": F.lit("x"), "node": F.lit(1), "_part": F.lit(0)})
    got = [tuple(r) for r in merkle.verify(docs, remainder(5) == 0).collect()]
    assert Counter(got) == Counter(expected_manifest(corpus))
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_path_proves_a_leaf_and_nothing_else(spark, corpus):
    rows = merkle.manifest(spark.createDataFrame(corpus[:40], DOC))
    forged = merkle.fold(F.sha2(F.lit("x").cast("binary"), 256), F.col("path")) == F.col("root")
    kept = merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")
    assert rows.select(F.sum(forged.cast("int")), F.sum(kept.cast("int"))).first() == (0, 40)


def test_manifest_of_no_rows_and_of_one(spark, corpus):
    empty = spark.createDataFrame([], DOC)
    assert merkle.verify(empty, remainder(5) == 0).collect() == []
    one = merkle.manifest(spark.createDataFrame(corpus[:1], DOC)).first()
    assert one.leaf == one.subroot == one.root and one.path == []


def expected_draw(corpus, target, settings):
    def buckets(text):
        found = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").translate(LOW).encode())
        pairs = [a + b" " + b for a, b in zip(found, found[1:])]
        return len(found), [zlib.crc32(f) % settings.buckets for f in [*found, *pairs]]

    held = Counter(b for r in corpus for b in buckets(r[1])[1])
    wanted = Counter(b for t in target for b in buckets(t)[1])
    s, t, size = sum(held.values()), sum(wanted.values()), settings.buckets
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + size) / ((held[b] + 1) * (t + size)))) for b in range(size)]
    rows = []
    for doc, text, *_ in corpus:
        n, found = buckets(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(sha(f"{settings.key}:{'' if doc is None else doc}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, len(found), weight, score, n >= settings.least_words))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1]))
    drawn = [(*r[:4], i + 1) for i, r in enumerate(able[: len(able) * settings.percent // 100])]
    left = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return Counter(drawn) + Counter((*r, None) for r in left.elements())


@pytest.mark.parametrize("settings", [resampling.Settings(), resampling.Settings(50, "k", 1, 100), resampling.Settings(percent=0)])
def test_draw_equals_brute_force(spark, corpus, settings):
    docs = spark.createDataFrame(corpus, DOC).withColumns({"rank": F.lit("x"), "buckets": F.lit(1), "score": F.lit(2)})
    target = ["Thea ofb ita itb", None, "", "a1c " * 30]
    goal = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    got = resampling.resample(docs, goal, settings).select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(tuple(r) for r in got.collect()) == expected_draw(corpus, target, settings)


def test_draw_among_many_ties(spark):
    rows = spark.range(500).selectExpr("id % 100 AS doc_id", "1L AS n_features", "5L AS score", "true AS eligible")
    drawn = resampling.draw(rows, 123).where("rank IS NOT NULL").collect()
    assert sorted(r.rank for r in drawn) == list(range(1, 124))
    assert Counter(r.doc_id for r in drawn) == Counter({d: 5 for d in range(24)} | {24: 3})


def test_draw_from_no_rows_and_towards_nothing(spark, corpus):
    empty, goal = spark.createDataFrame([], DOC), spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(empty, goal).collect() == []
    rows = resampling.resample(spark.createDataFrame(corpus, DOC), goal)
    assert rows.where("rank IS NOT NULL").count() == rows.where("n_words >= 20").count() // 4
