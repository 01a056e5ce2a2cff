"""Row-by-row comparison of a query with its SQL twin in an embedded engine, used by the tests."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def differences(df: DataFrame, sql: str, sf_dir: str) -> list[str]:
    """What keeps the two results from being equal; empty if nothing does."""
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    order = sorted(names)
    ours = Counter(tuple(_plain(r[c]) for c in order) for r in df.select(*order).collect())
    at = [names.index(c) for c in order]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in cursor.fetchall())
    if ours == theirs:
        return []
    only, lacking = list((ours - theirs).elements()), list((theirs - ours).elements())
    return [
        f"{sum(ours.values())} against {sum(theirs.values())} rows, {len(only)} differ",
        f"columns: {order}",
        *[f"only ours:   {r}" for r in sorted(only, key=str)[:3]],
        *[f"only theirs: {r}" for r in sorted(lacking, key=str)[:3]],
    ]
