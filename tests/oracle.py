"""Comparison of a query with its DuckDB twin: same columns, same rows in any order."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return db


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(str(plain(v)) for v in row) for row in frame.itertuples(index=False))


def agree(found, db, sql: str) -> None:
    db.execute(sql)
    expected = db.df()
    found = found.toPandas()
    assert sorted(found.columns) == sorted(expected.columns)
    assert _rows(found) == _rows(expected)
