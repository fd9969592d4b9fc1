"""Compare a Spark result with the checking engine: same columns, types, rows and values."""

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def kind(arrow_type):
    name = str(arrow_type).replace("large_", "")
    return {"decimal128(38, 0)": "hugeint"}.get(name, name.split(" not null")[0].replace("[us, tz=UTC]", "[us]"))


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "~" if v != v else repr(v + 0.0)
    if isinstance(v, list):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{cell(v[k])}" for k in sorted(v)) + "}"
    return str(v)


def rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted("|".join(cell(v) for v in row) for row in zip(*columns))


def compare(df, con, sql):
    """Empty text when equal, else what differs."""
    got = df.toArrow()
    want = con.execute(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"
    types = [
        f"{n}: {kind(got.schema.field(n).type)} != {kind(want.schema.field(n).type)}"
        for n in sorted(got.column_names)
        if kind(got.schema.field(n).type) != kind(want.schema.field(n).type)
    ]
    a, b = rows(got), rows(want)
    problem = ""
    if a != b:
        left, right = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        problem = f"rows {len(a)} vs {len(b)}; only spark {left}; only sql {right}"
    return "; ".join(filter(None, [problem, ", ".join(types)]))
