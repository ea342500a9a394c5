"""Compare registered queries with their SQL: ``python tests/oracle_check.py [sf] [name ...]``."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def normal(value):
    if hasattr(value, "to_pydatetime"):
        value = value.to_pydatetime()
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, list | tuple):
        return tuple(normal(v) for v in value)
    return value


def families(arrow_schema):
    """Column name -> broad type; ``bigint`` against ``double`` matters, 32 against 64 bit does not."""
    import pyarrow.types as t

    def family(kind):
        for name, test in (("int", t.is_integer), ("float", t.is_floating), ("decimal", t.is_decimal),
                           ("bool", t.is_boolean), ("time", t.is_timestamp), ("date", t.is_date)):
            if test(kind):
                return name
        return "text" if t.is_string(kind) or t.is_large_string(kind) else str(kind)

    return {f.name: family(f.type) for f in arrow_schema}


def difference(spark_df, con, sql):
    """None when both sides have the same columns, types and multiset of rows; else a description."""
    arrow = spark_df.toArrow()
    expected = con.sql(sql).to_arrow_table()
    got_types, want_types = families(arrow.schema), families(expected.schema)
    if got_types != want_types:
        return f"columns differ: {got_types} != {want_types}"
    names = sorted(got_types)

    def rows(table):
        columns = [table.column(n).to_pylist() for n in names]
        out = [tuple(normal(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else normal(v) for v in r) for r in zip(*columns)]
        return sorted(out, key=repr)

    got, want = rows(arrow), rows(expected)
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{names}: {g} != {w}"
    return None


def main():
    import __spark_entry__
    from millrace.session import build_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session("oracle-check", master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    bad = 0
    for name in args or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem = difference(df, con, oracles[name]) if name in oracles else f"rows only: {df.count()}"
        except Exception as err:  # report and go on with the next query
            problem = f"{type(err).__name__}: {str(err)[:1500]}"
        bad += problem is not None and not problem.startswith("rows only")
        print(f"{'ok ' if problem is None else '-- '} {name:28s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} differences")


if __name__ == "__main__":
    main()
