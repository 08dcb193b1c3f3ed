"""Run the registered queries beside their SQL and compare the results value by value.

    python -m checks.compare FOLDER [QUERY ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from callsift.session import build_session, ensure_shared_dir
from checks.oracle import SQL
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def shown(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, pd.Timestamp) or hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    return repr(value.item() if hasattr(value, "item") else value)


def rows(table) -> list[tuple]:
    """All rows as sorted text tuples, columns by name."""
    names = sorted(table.column_names)
    columns = [[shown(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns, strict=True))


def kinds(table) -> dict[str, str]:
    plain = {"large_string": "string", "decimal128": "decimal"}
    return {f.name: plain.get(str(f.type), str(f.type)) for f in table.schema}


def differences(spark, con, folder: str, name: str) -> list[str]:
    ours = QUERIES[name](spark, folder).toArrow()
    if name not in SQL:
        return []
    theirs = con.sql(SQL[name]).to_arrow_table()
    found = []
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return [f"columns {sorted(ours.column_names)} / {sorted(theirs.column_names)}"]
    left, right = kinds(ours), kinds(theirs)
    odd = {c: (left[c], right[c]) for c in left
           if left[c] != right[c] and not left[c].startswith(("timestamp", "date"))}
    if odd:
        found.append(f"types {odd}")
    if ours.num_rows != theirs.num_rows:
        found.append(f"rows {ours.num_rows} / {theirs.num_rows}")
    a, b = rows(ours), rows(theirs)
    if a != b:
        first = next((p for p in zip(a, b, strict=False) if p[0] != p[1]), None)
        wrong = sum(x != y for x, y in zip(a, b, strict=False))
        found.append(f"values: {wrong} rows, first {str(first)[:600]}")
    return found


def main(folder: str, names: list[str]) -> int:
    spark = ensure_shared_dir(
        build_session("checks", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            found = differences(spark, con, folder, name)
        except Exception as error:  # one broken query must not hide the others
            found = [f"{type(error).__name__}: {str(error)[:500]}"]
        failed += bool(found)
        mark = "FAIL" if found else ("ok" if name in SQL else "rows only")
        print(f"{mark:9} {name} {time.time() - start:.1f}s {' | '.join(found)}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
