"""Language identification: known words first, shorter and shorter character n-grams for the others."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.text import FIRST, mix, slices, stage

ORDERS = (5, 4, 3, 2, 1)
EDGE = "\n"


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows the model is fitted on (about; chosen by hash), ``words``
    and ``grams`` the tables it keeps, the most frequent first. ``smooth`` is added to counts."""

    sample: int = 20_000
    words: int = 32_768
    grams: int = 32_768
    smooth: float = 0.5


@dataclass
class Table:
    """Sorted hashes and, for each, the log frequency in every language."""

    hashes: np.ndarray
    logs: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are in the table, and the rows of those."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.empty(0, int)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        return known, at[known]


@dataclass
class Model:
    """Languages, their shares of the training rows, the word table and one table per n-gram order."""

    languages: list[str]
    shares: np.ndarray
    words: Table
    grams: dict[int, Table]


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters; the first and last code points are no letters."""
    letter = _letters()[points]
    change = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    return change[::2], change[1::2]


def _values(points: np.ndarray) -> np.ndarray:
    """A 64-bit value per code point; all that are no letters share one."""
    return mix(np.where(_letters()[points], points, 10).astype(np.uint64) + np.uint64(1 << 33))


def _joined(texts: list[str | None]) -> tuple[str, np.ndarray]:
    """Lower-cased texts between line ends, and where each begins."""
    lowered = [(t or "").lower() for t in texts]
    return EDGE + EDGE.join([*lowered, ""]), np.cumsum([1, *[len(t) + 1 for t in lowered]])


def _hash_of(text: str) -> int:
    """Hash of a word or an n-gram on its own, as found inside a buffer."""
    values = _values(_points(text))
    return int(FIRST.spans(values, np.array([0]), np.array([len(values)]))[0])


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and n-grams of each language in a batch; order 0 stands for words."""
    for piece in slices(batches, limit=8 << 20):
        by_language: dict[str, Counter] = {}
        for language, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist()):
            joined, _ = _joined([text])
            starts, ends = _spans(_points(joined))
            by_language.setdefault(language, Counter()).update(joined[s:e] for s, e in zip(starts, ends))
        rows = []
        for language, seen in by_language.items():
            grams: Counter = Counter()
            for word, n in seen.items():
                padded = EDGE + word + EDGE
                for order in ORDERS:
                    for i in range(len(padded) - order + 1):
                        grams[order, padded[i : i + order]] += n
            rows += [(language, 0, word, n) for word, n in seen.items()]
            rows += [(language, order, gram, n) for (order, gram), n in grams.items()]
        names = ["lang", "grade", "gram", "n"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]
        columns = zip(*rows) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def fit(rows: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Fit on ``text, lang``, neither null; None without rows. Only the tables reach the driver."""
    total = rows.count()
    if not total:
        return None
    share = settings.sample / total
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)) if share < 1 else rows
    counted = chosen.select("text", "lang").mapInArrow(_count, "lang string, grade int, gram string, n long")
    counted = stage(counted.groupBy("lang", "grade", "gram").agg(F.sum("n").alias("n")), "grams")
    frequent = counted.groupBy("grade", "gram").agg(F.sum("n").alias("n"))
    held = frequent.where("grade = 0").orderBy(F.desc("n"), "gram").limit(settings.words)
    held = held.unionByName(frequent.where("grade > 0").orderBy(F.desc("n"), "grade", "gram").limit(settings.grams))
    table = counted.join(held.select("grade", "gram"), ["grade", "gram"]).toArrow()
    sizes = rows.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in sizes)
    number = {x: i for i, x in enumerate(languages)}
    shares = np.array([{r["lang"]: r["count"] for r in sizes}[x] / total for x in languages])
    by_grade: dict[int, dict[str, np.ndarray]] = {g: {} for g in (0, *ORDERS)}
    for grade, gram, language, n in zip(*[table.column(c).to_pylist() for c in ("grade", "gram", "lang", "n")]):
        by_grade[grade].setdefault(gram, np.zeros(len(languages)))[number[language]] = n
    tables = {}
    for grade, seen in by_grade.items():
        hashes = np.array([_hash_of(g) for g in seen], np.uint64)
        counts = np.array(list(seen.values())).reshape(-1, len(languages)) + settings.smooth
        order = np.argsort(hashes)
        tables[grade] = Table(hashes[order], np.log(counts / counts.sum(axis=0))[order])
    return Model(languages, shares, tables.pop(0), tables)


def _log_scores(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: summed log scores of the languages, words scored, and whether it has a letter."""
    joined, begins = _joined(texts)
    points = _points(joined)
    starts, ends = _spans(points)
    owner = np.searchsorted(begins, starts, "right") - 1
    values = _values(points)
    scores = np.zeros((len(starts), len(model.languages)))
    known, rows = model.words.find(FIRST.spans(values, starts, ends))
    scores[known] = model.words.logs[rows]
    scored = known.copy()
    left = np.flatnonzero(~known)
    for order in ORDERS:
        # the word with one edge on each side
        room = np.maximum(ends[left] - starts[left] + 2 - order + 1, 0)
        word = np.repeat(np.arange(len(left)), room)
        first = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + (starts[left] - 1)[word]
        found, rows = model.grams[order].find(FIRST.spans(values, first, first + order))
        hits = np.bincount(word[found], minlength=len(left))
        logs = model.grams[order].logs[rows]
        sums = np.stack([np.bincount(word[found], weights=c, minlength=len(left)) for c in logs.T], axis=1)
        done = hits > 0
        scores[left[done]] = sums[done] / hits[done, None]
        scored[left[done]] = True
        left = left[~done]
    totals = np.stack([np.bincount(owner, weights=c, minlength=len(texts)) for c in scores.T], axis=1)
    words = np.bincount(owner, weights=scored, minlength=len(texts))
    return totals, words, np.bincount(owner, minlength=len(texts)) > 0


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns but ``text``, then ``lang_pred`` and ``score``, from the text alone.

    A known word adds its log frequency in each language; an unseen one the mean log frequency of
    its known n-grams of the longest order that has any, edges included. The language of the largest
    sum is predicted (ties: the first by name), and the score is its share if each language counts by
    the exponential of its mean over words, times at most ten. A text whose words have no known part
    gets the most frequent language. Null text, no letter, or no model: ``und`` and 0.
    """
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*[f"`{c}` {t}" for c, t in docs.dtypes if c != "text"], "lang_pred string", "score double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            names, sure = ["und"] * piece.num_rows, np.zeros(piece.num_rows)
            if model:
                totals, words, letters = _log_scores(model, piece.column("text").to_pylist())
                mean = totals / np.maximum(words, 1)[:, None] * np.minimum(words, 10)[:, None]
                weight = np.exp(mean - mean.max(axis=1, keepdims=True))
                weight = np.where(words[:, None] > 0, weight, model.shares)
                best = weight.argmax(axis=1)
                share = weight[np.arange(len(best)), best] / weight.sum(axis=1)
                names = [model.languages[b] if x else "und" for b, x in zip(best, letters)]
                sure = np.where(letters, share, 0.0)
            columns = [piece.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(sure)], [*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
