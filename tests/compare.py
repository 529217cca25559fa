"""Rows of Spark and of DuckDB in one form."""

import math


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, int | float):
        return None if isinstance(value, float) and math.isnan(value) else float(value)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return str(value)


def rows_of_spark(df, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_duck(rel, columns):
    at = [rel.columns.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def same(df, rel):
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    ours, theirs = rows_of_spark(df, columns), rows_of_duck(rel, columns)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == b
