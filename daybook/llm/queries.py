"""Queries on the text tables, one for each operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import (
    brown,
    decontaminate,
    extraction,
    language,
    line_dedup,
    merkle,
    mixing,
    recompression,
    resampling,
    simhash,
    suffix,
    toxicity,
    twins,
    vector_file,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query of the session and the folder, with the SQL that must give the same rows."""

    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = build
        if sql:
            TWINS[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"

MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS}) AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS mark FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    ([1.5, 1.0, 0.5]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS ramp_start,
    ([0.5, 1.0, 1.5]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS ramp_end
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2 * source_size AS most, 1.5 * sum(source_size) OVER ()::DOUBLE
    - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS remaining,
    sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest
  FROM sources),
level AS (
  SELECT remaining, rest FROM ranked WHERE remaining * weight / rest <= most
  ORDER BY most / weight, source NULLS LAST LIMIT 1),
goals AS (
  SELECT source, source_size, ramp_start, ramp_end,
    least(coalesce((SELECT remaining FROM level) * weight / (SELECT rest FROM level), most::DOUBLE),
      most::DOUBLE) AS target
  FROM ranked),
queued AS (
  SELECT doc_id, size, source_size, target, ramp_start, ramp_end,
    (sum(size) OVER (PARTITION BY sized.source ORDER BY mark, doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE - size / 2.0::DOUBLE AS middle
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source),
slots AS (
  SELECT *, CASE WHEN size > 0 AND middle <= target THEN middle / target END AS once,
    CASE WHEN size > 0 AND middle + source_size <= target THEN (middle + source_size) / target END AS again,
    (ramp_start + ramp_end) / 2 AS mean, ramp_end - ramp_start AS slope
  FROM queued)
SELECT doc_id, size, source_size, target,
  (size * ((once IS NOT NULL)::BIGINT + (again IS NOT NULL)::BIGINT))::BIGINT AS taken,
  2 * once * mean / (ramp_start + sqrt(greatest(ramp_start * ramp_start + 2 * slope * once * mean, 0)))
    AS first_position,
  2 * again * mean / (ramp_start + sqrt(greatest(ramp_start * ramp_start + 2 * slope * again * mean, 0)))
    AS second_position
FROM slots
"""


@query("op2_mixing", MIX_SQL)
def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    columns = ["doc_id", "size", "source_size", "target", "taken", "first_position", "second_position"]
    return mixed.select(*columns).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


@query("op7_simhash")
def _simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_line_dedup")
def _line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return cut.select("doc_id", "n_lines", "n_removed", "n_partners", digest)


@query("op9_toxicity")
def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_decontamination")
def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(documents, benchmark).select("doc_id", "item_id", "similarity", "start")


def remainder(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@query("op4_brown")
def _brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model, counts = brown.fit(documents.where(remainder(10) != 0).select("text"))
    marked = documents.select("doc_id", (remainder(10) == 0).alias("held_out"), "text")
    scored = brown.score(marked, model, counts)
    order = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long")).select(*order)


@query("op5_language")
def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    learned = documents.where((remainder(4) != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    model = language.fit(learned.select("text", "lang"))
    marked = documents.select("doc_id", (remainder(4) == 2).alias("held_out"), "text")
    return language.predict(marked, model)


TOP_SQL = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM ints q JOIN ints c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op8_vector_file", TOP_SQL)
def _vector_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vector_file.integer_vectors(table(spark, sf_dir, "embeddings"))
    return vector_file.search(vectors, vectors.where("vec_id % 100 = 0"))


REPEAT_SQL = rf"""
WITH split AS (SELECT doc_id, {WORDS} AS words FROM documents),
windows AS (
  SELECT doc_id, pos, sha256(array_to_string(words[pos:pos + 49], ' ')) AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM split WHERE len(words) >= 50)),
late AS (
  SELECT doc_id, pos FROM windows
  JOIN (SELECT gram, min(doc_id) AS least FROM windows GROUP BY gram) USING (gram) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, pos + step AS pos FROM late, range(50) r(step)),
pieces AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM split),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text
  FROM pieces WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = pieces.doc_id AND gone.pos = pieces.pos)
  GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""


@query("op3_recompression", REPEAT_SQL)
def _recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


BYTES_SQL = """
WITH split AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS code FROM documents),
strings AS (
  SELECT doc_id, code, unnest(range(0, len(code) // 2 - 399)) AS pos FROM split WHERE len(code) >= 800),
marked AS (SELECT doc_id, pos, md5(substr(code, 2 * pos + 1, 800)) AS mark FROM strings),
twice AS (SELECT mark FROM marked GROUP BY mark HAVING count(*) > 1),
starts AS (SELECT doc_id, pos FROM marked SEMI JOIN twice USING (mark)),
edged AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 400 THEN 0 ELSE 1 END AS edge
  FROM starts WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
numbered AS (SELECT *, sum(edge) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM edged),
spans AS (SELECT doc_id, span, min(pos) AS a, max(pos) + 400 AS b FROM numbered GROUP BY ALL),
gaps AS (
  SELECT doc_id, b AS a, coalesce(lead(a) OVER w, len(code) // 2) AS b, b AS place
  FROM spans JOIN split USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, 0, min(a), -1 FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(code, 2 * a + 1, 2 * (b - a)), '' ORDER BY place) AS left_code
  FROM gaps JOIN split USING (doc_id) GROUP BY doc_id),
lost AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, (len(code) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_code, code))) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""


@query("op6_suffix_array", BYTES_SQL)
def _suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


@query("op11_merkle", twins.MERKLE)
def _merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"), remainder(5) == 0)


@query("op12_resampling", twins.RESAMPLING)
def _resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_html")
def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extraction.extract(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
