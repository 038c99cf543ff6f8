"""Compares a query's rows with those of its oracle SQL in DuckDB."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_oracle(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    r = c.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def canonical(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return ("nan" if v != v else v + 0.0)
        if isinstance(v, dict):
            return tuple(map(plain, v.values()))
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, sql: str, sf_dir: str) -> str | None:
    names, expected = rows_of_oracle(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours = canonical(df.columns, [tuple(r) for r in df.collect()])
    theirs = canonical(names, expected)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    kinds = {(type(x).__name__, type(y).__name__) for a, b in zip(ours, theirs) for x, y in zip(a, b) if x is not None and y is not None and type(x) is not type(y)}
    return f"{len(bad)} rows differ, such as {bad[0]}" if bad else f"types {kinds}" if kinds else None
