"""Hold a query against its SQL as the driver does: columns by name, rows in any order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]

    def one(x):
        x = x.item() if hasattr(x, "item") else x
        if not isinstance(x, (list, dict)) and pd.isna(x):
            return "null"
        # a column of integers with nulls comes as floats from one side
        return repr(round(float(x), 9)) if isinstance(x, (int, float)) and not isinstance(x, bool) else repr(x)

    return sorted(tuple(one(v) for v in r) for r in pdf.itertuples(index=False, name=None))


def expected(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def same(df, sql, sf_dir):
    got, want = df.toPandas(), expected(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b
    return len(a)
