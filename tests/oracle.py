"""Comparison of a query with its SQL, as rows of text."""

from pathlib import Path


def canon(v):
    """A value as text; numbers to nine digits, whatever their type."""
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return str([canon(x) for x in v])
    if hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    return str(v)


def compared(spark, data, query, sql):
    """(rows of the query, rows of the SQL), columns by name, rows sorted."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = query(spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    con_rows = con.execute(sql)
    names = [x[0] for x in con_rows.description]
    assert sorted(names) == cols
    want = sorted(tuple(canon(x[names.index(c)]) for c in cols) for x in con_rows.fetchall())
    return got, want
