"""Order-insensitive comparison of a Spark result with DuckDB's."""

import math


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if hasattr(v, "is_finite"):
        return f"{float(v):.6g}"
    return str(v)


def same(spark_df, relation):
    columns = sorted(spark_df.columns)
    assert columns == sorted(relation.columns)
    names = relation.columns
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in spark_df.collect())
    theirs = sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in relation.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert a == b
