"""Queries against their SQL: the rows of both must agree."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings train valid test synthetic_data judge_predictions run_results label_targets mix_targets pack_sizes name_parts".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 8)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def differences(df, con: duckdb.DuckDBPyConnection, text: str) -> list[str]:
    names = sorted(df.columns)
    cursor = con.execute(text)
    theirs = [d[0] for d in cursor.description]
    if sorted(theirs) != names:
        return [f"columns {names} and {sorted(theirs)}"]
    ours = Counter(tuple(plain(r[n]) for n in names) for r in (row.asDict(recursive=True) for row in df.collect()))
    place = [theirs.index(n) for n in names]
    other = Counter(tuple(plain(r[i]) for i in place) for r in cursor.fetchall())
    return [f"only ours {c}: {r}" for r, c in (ours - other).most_common(3)] + [f"only SQL {c}: {r}" for r, c in (other - ours).most_common(3)]
