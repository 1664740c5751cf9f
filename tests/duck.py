"""Compare a query with its SQL in DuckDB, as sets of rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def normal(df, other=None):
    """Sorted rows in one form: numbers that are whole on both sides as they are, others rounded to six places, the rest as text."""
    other = df if other is None else other
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kinds = {str(x[c].dtype).lower().rstrip("0123456789").lstrip("u") for x in (df, other) if c in x}
        if kinds == {"int"}:
            df[c] = df[c].astype("Int64")
        elif kinds <= {"int", "float", "bool", "boolean"}:
            df[c] = df[c].astype(float).round(6)
        else:
            df[c] = df[c].astype(str).replace({"<NA>": "None", "nan": "None"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(spark, folder, query, sql):
    mine, theirs = query(spark, folder).toPandas(), duck(folder).sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert normal(mine, theirs).equals(normal(theirs, mine))
