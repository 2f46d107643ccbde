"""Run registered queries beside their SQL twins and report the differences.

    python -m tests.compare [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from corvane.queries.views import GIVEN


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def kind(dtype: str) -> str:
    dtype = dtype.lower()
    for prefix, label in (("bigint", "long"), ("int", "int"), ("double", "double"), ("float", "float"),
                          ("string", "string"), ("varchar", "string"), ("bool", "bool"), ("timestamp", "ts"),
                          ("hugeint", "hugeint"), ("decimal", "decimal"), ("date", "date")):
        if dtype.startswith(prefix):
            return label
    return dtype


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(
        (tuple("NULL" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else
               (repr(float(v)) if isinstance(v, float) else str(v)) for v in row)
         for row in frame.astype(object).itertuples(index=False, name=None)))


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else a short account."""
    relation = con.sql(sql)
    expected_types = {c: kind(str(t)) for c, t in zip(relation.columns, relation.types)}
    actual_types = {f.name: kind(f.dataType.simpleString()) for f in spark_df.schema.fields}
    if expected_types != actual_types:
        return f"schema {actual_types} != {expected_types}"
    actual, expected = rows(spark_df.toPandas()), rows(relation.df())
    if actual == expected:
        return None if actual else "both empty"
    extra = [r for r in actual if r not in set(expected)][:3]
    missing = [r for r in expected if r not in set(actual)][:3]
    return f"{len(actual)} rows vs {len(expected)}; only spark {extra}; only sql {missing}"


def main() -> None:
    import __spark_entry__ as entry
    from corvane.plans.runtime import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(p.lower() for p in sys.argv[2:])
    spark = build_session("compare", "local[8]", 8, spark__driver__memory="16g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if prefixes and not name.lower().startswith(prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                found = difference(df, con, oracles[name])
            else:
                n = len(df.toPandas())
                found = None if n else "no rows"
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        took = time.time() - start
        label = "sql " if name in oracles else "rows"
        bad += found is not None
        if found or took > 4 or not prefixes:
            print(f"{'FAIL' if found else 'ok  '} {label} {took:6.2f}s {name} {found or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
