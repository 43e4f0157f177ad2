"""Compare a query with its SQL: columns, and rows in any order."""

from __future__ import annotations


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows_of(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def check(spark, duck, data, query, sql) -> int:
    df = query(spark, data)
    found = duck.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(found.columns, found.fetchall())
    assert ours == theirs
    return len(ours)
