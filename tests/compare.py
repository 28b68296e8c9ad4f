"""Run catalog queries next to their SQL: ``python tests/compare.py SF_DIR [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _kind(dtype) -> str:
    text = str(dtype).lower()
    for key, kinds in {
        "integer": ("bigint", "int", "integer", "long"),
        "double": ("double", "float"),
        "string": ("string", "varchar"),
        "boolean": ("boolean",),
    }.items():
        if text in kinds:
            return f"{key}:{'32' if text in ('int', 'integer') else ''}"
    return text


def difference(spark_df, relation) -> str | None:
    """Why the two results differ, or None."""
    mine = {f.name: _kind(f.dataType.simpleString()) for f in spark_df.schema.fields}
    other = {c: _kind(t) for c, t in zip(relation.columns, relation.types)}
    if mine != other:
        return f"columns {sorted(mine.items())} != {sorted(other.items())}"
    columns = sorted(mine)

    def rows(frame: pd.DataFrame):
        cells = frame[columns].astype(object).where(frame[columns].notna(), None)
        out = []
        for row in cells.itertuples(index=False):
            out.append(
                tuple(
                    None
                    if v is None
                    else repr(float(v) + 0.0)
                    if mine[c].startswith("double")
                    else str(int(v))
                    if mine[c].startswith("integer")
                    else str(v)
                    for c, v in zip(columns, row)
                )
            )
        return sorted(out, key=repr)

    left = rows(pd.DataFrame([r.asDict() for r in spark_df.collect()], columns=spark_df.columns))
    right = rows(pd.DataFrame(relation.fetchall(), columns=relation.columns))
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, first {wrong[0]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from siftwall.session import build_session

    spark = build_session(
        "compare",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    sql = entry.oracle_sql()
    connection = duck(sf_dir)
    bad = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sql:
                verdict = difference(df, connection.sql(sql[name]))
                note = "ok" if verdict is None else verdict
                rows = connection.sql(f"SELECT count(*) FROM ({sql[name]})").fetchall()[0][0]
            else:
                verdict, rows = None, df.count()
                note = "rows only"
        except Exception as error:  # noqa: BLE001
            verdict = note = f"{type(error).__name__}: {str(error)[:600]}"
            rows = -1
        bad += verdict is not None
        print(f"{name:32s} {rows:8d} {time.time() - start:6.2f}s  {note}", flush=True)
    missing = set(sql) - set(entry.queries())
    if missing:
        print("SQL without a query:", missing)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
