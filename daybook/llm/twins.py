"""SQL twins of the manifest and of importance resampling."""

from __future__ import annotations

#: Table of CRC-32, and its value for a text column or expression ``{0}``; needs ``crc_table``.
CRC_TABLE = """
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc)"""
CRC = """xor(list_reduce(list_transform(range(octet_length(encode({0}))),
    lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, crc[xor(c % 256, b) + 1]), 4294967295), 4294967295)"""


def _tree(name: str, start: str, key: str, levels: int) -> str:
    """Nodes and siblings of every level above ``start`` (key, i, n, h), and the last nodes."""
    parts, below = [], start
    for k in range(levels):
        parts.append(f"""
{name}_side{k} AS (
  SELECT {key}, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY {key}, i // 16 ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY {key}, i // 16 ORDER BY i
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {below}),
{name}{k + 1} AS (
  SELECT {key}, i // 16 AS i, (n + 15) // 16 AS n,
    CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM {below} GROUP BY {key}, i // 16, n)""")
        below = f"{name}{k + 1}"
    return ",".join(parts)


def _walk(name: str, start: str, key: str, columns: str, levels: int) -> str:
    """Fold ``found`` and collect ``proof`` through the levels of a tree; ``spot`` is the position."""
    parts, below = [], start
    for k in range(levels):
        parts.append(f"""
{name}_walk{k} AS (
  SELECT {", ".join(f"{below}.{c}" for c in columns.split())}, spot // 16 AS spot, proof || CASE WHEN n > 1 THEN l || r ELSE '' END AS proof,
    CASE WHEN n > 1 THEN sha256(l || found || r) ELSE found END AS found
  FROM {below} JOIN {name}_side{k} ON {name}_side{k}.{key} = {below}.{key} AND i = spot)""")
        below = f"{name}_walk{k}"
    return ",".join(parts)


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: Levels of the two trees: up to 16 to their power of leaves a source, and of sources.
_LEAF_LEVELS, _SOURCE_LEVELS = 6, 3

MERKLE = f"""
WITH {CRC_TABLE},
hashed AS (
  SELECT doc_id, source, sha256({_HEAD} || {_FIELD.format('text')}) AS h,
    CASE WHEN {CRC.format("coalesce(doc_id::VARCHAR, '')")} % 5 = 0
      THEN sha256({_HEAD} || {_FIELD.format(_LOW)}) END AS changed
  FROM documents, crc_table),
numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS s, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM hashed),
{_tree('leaf', 'numbered', 's', _LEAF_LEVELS)},
sources AS (SELECT 0 AS t, s - 1 AS i, count(*) OVER () AS n, h FROM leaf{_LEAF_LEVELS}),
{_tree('top', 'sources', 't', _SOURCE_LEVELS)},
begun AS (SELECT doc_id, s, 0 AS t, i AS spot, h AS leaf, '' AS proof, coalesce(changed, h) AS found FROM numbered),
{_walk('leaf', 'begun', 's', 'doc_id leaf t s', _LEAF_LEVELS)},
joined AS (SELECT doc_id, leaf, t, s - 1 AS spot, s, proof, found FROM leaf_walk{_LEAF_LEVELS - 1}),
{_walk('top', 'joined', 't', 'doc_id leaf s t', _SOURCE_LEVELS)}
SELECT doc_id, leaf, leaf{_LEAF_LEVELS}.h AS subroot, top{_SOURCE_LEVELS}.h AS root,
  sha256(proof) AS proof_sha256, found AS folded_root, found = top{_SOURCE_LEVELS}.h AS verified
FROM top_walk{_SOURCE_LEVELS - 1} w JOIN leaf{_LEAF_LEVELS} ON leaf{_LEAF_LEVELS}.s = w.s, top{_SOURCE_LEVELS}
"""

_SPLIT = r"""list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""
_FEATURES = """unnest(list_concat(words,
    list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature"""

RESAMPLING = f"""
WITH {CRC_TABLE},
split AS (SELECT row_number() OVER () AS row, doc_id, {_SPLIT} AS words FROM documents),
wanted_split AS (SELECT {_SPLIT} AS words FROM benchmark),
held AS (SELECT row, feature, count(*) AS n FROM (SELECT row, {_FEATURES} FROM split) GROUP BY ALL),
wanted AS (SELECT feature, count(*) AS n FROM (SELECT {_FEATURES} FROM wanted_split) GROUP BY ALL),
hashed AS (SELECT feature, {CRC.format("feature")} % 10000 AS bucket
  FROM (SELECT feature FROM held UNION SELECT feature FROM wanted), crc_table),
s AS (SELECT bucket, sum(n)::BIGINT AS n FROM held JOIN hashed USING (feature) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS n FROM wanted JOIN hashed USING (feature) GROUP BY bucket),
gain AS (
  SELECT b.range AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE
      * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000)
      / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS g
  FROM range(10000) b LEFT JOIN s ON s.bucket = b.range LEFT JOIN t ON t.bucket = b.range),
summed AS (SELECT row, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS total
  FROM held JOIN hashed USING (feature) JOIN gain USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, len(words) AS n_words, coalesce(n, 0)::BIGINT AS n_features,
    CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM split LEFT JOIN summed USING (row)),
ranked AS (
  SELECT row, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features) AS place,
    count(*) OVER () AS able
  FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= 25 * able // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (row)
"""
