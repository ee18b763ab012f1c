"""Run every registered query and its SQL statement over the same tables and compare the rows."""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(row[i]) for i in order) for row in rows]
    return sorted(out, key=repr)


def _value(value):
    if isinstance(value, float) and value.is_integer() and not math.isinf(value):
        return int(value)
    return str(value) if value.__class__.__name__ in ("datetime", "Decimal", "date") else value


def difference(spark_df, con, sql: str) -> str | None:
    """None when column names and rows are equal."""
    rows = spark_df.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    mine, theirs = canonical(spark_df.columns, rows), canonical(names, result.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)} rows"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{str(a)[:400]}\n  and {str(b)[:400]}"
    return None


def main(folder: str, wanted: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).parent.parent))
    from tests.conftest import new_session
    import __spark_entry__ as contract
    spark, con, bad = new_session(), database(folder), 0
    oracle = contract.oracle_sql()
    for name, run in contract.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            found = difference(df, con, oracle[name])
            size = "" if found else f"{df.count()} rows" if wanted else ""
        except Exception as error:
            found, size = f"{type(error).__name__}: {str(error)[:800]}", ""
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - start:.1f}s {size}"
              + (f"\n  {found}" if found else ""), flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
