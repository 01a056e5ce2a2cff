"""Toxicity by a classifier chain of linear models on words, trained with out-of-fold predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.text import stage
from daybook.session import scratch_path

# The chain, in order: junk, texts that hold words of the toxic ones, toxic texts.
CATEGORIES = ("low_quality", "abusive", "toxic")
LETTERS = r"[^\p{L}]+"


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that the classifier is fitted on (about; chosen by hash),
    ``vocabulary`` the words it knows and ``lexicon`` the leading ones that mark a text as abusive.
    ``threshold`` is the cutoff where held-out rows of one class cannot tell any."""

    sample: int = 20_000
    vocabulary: int = 512
    lexicon: int = 48
    folds: int = 3
    iterations: int = 25
    penalty: float = 1e-3
    threshold: float = 0.5


@dataclass
class Chain:
    """Known words, per category the model or, if it had one class only, its probability, and from which
    probability of the last category on a text belongs to it."""

    words: list[str]
    models: list[LogisticRegressionModel | float]
    cutoff: float


def tokens(text: Column) -> Column:
    """Distinct runs of letters in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), LETTERS), lambda w: w != ""))


def _sampled(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id, words, quality, toxic`` of about ``sample`` labelled documents."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
    usable = usable.agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    share = settings.sample / max(1, usable.count())
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return stage(rows.select("doc_id", "toxic", "quality", tokens(F.col("text")).alias("words")), "labelled")


def _telling_words(rows: DataFrame, settings: Settings) -> list[str]:
    """Words whose presence tells toxic from other texts best, most telling of toxic ones first."""
    total = rows.agg(F.sum("toxic").alias("toxic_rows"), F.count("*").alias("all_rows"))
    seen = rows.select("toxic", F.explode("words").alias("word")).groupBy("word")
    seen = seen.agg(F.sum("toxic").alias("hits"), F.count("*").alias("n")).where("n > 2").crossJoin(F.broadcast(total))
    rate = (F.col("toxic_rows") + 1) / (F.col("all_rows") + 2)
    score = (F.col("hits") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    best = seen.select("word", score.alias("score")).orderBy(F.abs("score").desc(), "word").limit(settings.vocabulary)
    return [r.word for r in sorted(best.collect(), key=lambda r: (-r.score, r.word))]


def _vectorised(df: DataFrame, known: list[str]) -> DataFrame:
    model = CountVectorizerModel.from_vocabulary(known, inputCol="words", outputCol="presence")
    return model.setBinary(True).setMinTF(1.0).transform(df)


def _with_probability(df: DataFrame, model: LogisticRegressionModel | float, name: str, earlier: list[str]) -> DataFrame:
    """Append the probability of a category, a function of the words and the earlier ones."""
    if isinstance(model, float):
        return df.withColumn(name, F.lit(model))
    joined = VectorAssembler(inputCols=["presence", *earlier], outputCol="features").transform(df)
    scored = model.transform(joined).withColumn(name, vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def _fit(rows: DataFrame, label: str, earlier: list[str], settings: Settings) -> LogisticRegressionModel | float:
    held = rows.agg(F.avg(label).alias("share")).first().share
    if held in (None, 0.0, 1.0):
        return float(held or 0.0)
    joined = VectorAssembler(inputCols=["presence", *earlier], outputCol="features").transform(rows)
    learner = LogisticRegression(
        labelCol=label, maxIter=settings.iterations, regParam=settings.penalty, standardization=False
    )
    # the summary of a fit holds the session, which can not be sent to tasks once it has observed a frame
    path = scratch_path(rows.sparkSession, "category")
    learner.fit(joined.select("features", label)).write().save(path)
    return LogisticRegressionModel.load(path)


def _cutoff(held: DataFrame, name: str, settings: Settings) -> float:
    """The probability that best tells the classes apart on rows held out of the fits.

    Toxic texts are few, so that half is more than many of them reach. The F1 score of the verdicts, which
    weighs texts missed and others taken for them alike, is largest at the cutoff, halfway to the next row
    below, to a thousandth.
    """
    binned = held.groupBy(F.floor(F.col(name) * 1000).alias("bin"))
    bins = binned.agg(F.sum(f"is_{name}").alias("hits"), F.count("*").alias("n")).collect()
    hits, rows = (sum(r[c] for r in bins) for c in ("hits", "n"))
    if hits in (0, rows):
        return settings.threshold
    best, cutoff, found, taken = 0.0, settings.threshold, 0.0, 0
    ranked = sorted(bins, key=lambda r: -r.bin)
    for r, below in zip(ranked, [*(b.bin + 1 for b in ranked[1:]), 0]):
        found, taken = found + r.hits, taken + r.n
        if 2 * found / (hits + taken) > best:
            best, cutoff = 2 * found / (hits + taken), (r.bin + below) / 2000
    return cutoff


def fit_chain(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Chain | None:
    """Fit the chain on labelled documents; None if there are none.

    Each model but the first learns from the words and from the probabilities of the earlier
    categories, which for the training rows come from models that did not see the row's fold. Such
    probabilities of the last category give its cutoff.
    """
    rows = _sampled(docs, labels, settings)
    known = _telling_words(rows, settings)
    if not known:
        return None
    lexicon = F.array(*[F.lit(w) for w in known[: settings.lexicon]])
    rows = rows.select(
        "words",
        F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(settings.folds)).alias("fold"),
        F.coalesce((F.col("quality") == 0).cast("double"), F.lit(0.0)).alias("is_low_quality"),
        ((F.col("toxic") == 1) & F.arrays_overlap("words", lexicon)).cast("double").alias("is_abusive"),
        (F.col("toxic") == 1).cast("double").alias("is_toxic"),
    )
    rows = stage(_vectorised(rows, known).drop("words").coalesce(8), "training")
    models: list[LogisticRegressionModel | float] = []
    for number, name in enumerate(CATEGORIES):
        earlier = list(CATEGORIES[:number])
        models.append(_fit(rows, f"is_{name}", earlier, settings))
        unseen = None
        for fold in range(settings.folds):
            model = _fit(rows.where(F.col("fold") != fold), f"is_{name}", earlier, settings)
            part = _with_probability(rows.where(F.col("fold") == fold), model, name, earlier)
            unseen = part if unseen is None else unseen.unionByName(part)
        rows = stage(unseen.coalesce(8), "training")
    return Chain(known, models, _cutoff(rows, CATEGORIES[-1], settings))


def score(docs: DataFrame, chain: Chain | None, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, a probability for each category (``p_…``) and the boolean ``toxic``, per row.

    A null or empty text has no words and gets the probabilities of such a text; without a chain
    they are null and no document is toxic.
    """
    found = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    if chain is None:
        nothing = [F.lit(None).cast("double").alias(f"p_{c}") for c in CATEGORIES]
        return found.select("doc_id", *nothing, F.lit(False).alias("toxic"))
    known = F.array(*[F.lit(w) for w in chain.words])
    found = _vectorised(found.withColumn("words", F.array_intersect("words", known)), chain.words)
    for number, name in enumerate(CATEGORIES):
        found = _with_probability(found, chain.models[number], name, list(CATEGORIES[:number]))
    verdict = (F.col(CATEGORIES[-1]) >= chain.cutoff).alias("toxic")
    return found.select("doc_id", *[F.col(c).alias(f"p_{c}") for c in CATEGORIES], verdict)


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fit the chain on the labelled ones among the documents and score every document.

    ``labels`` has ``doc_id, quality, toxic``; rows with a null doc_id or toxic are not used, of
    repeated ones the more severe counts. Ties at the cutoff are toxic. Repeated documents are
    each scored; no documents give no rows.
    """
    return score(docs, fit_chain(docs, labels, settings), settings)


def keep_clean(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents not found toxic, by the text of each row; rows without a doc_id are judged too."""
    chain = fit_chain(docs, labels, settings)
    if chain is None:
        return docs
    keyed = docs.withColumn("_row", F.struct(*docs.columns))
    return score(keyed.select(F.col("_row").alias("doc_id"), "text"), chain, settings).where("NOT toxic").select("doc_id.*")
