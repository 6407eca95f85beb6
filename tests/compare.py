"""Run registered queries next to their SQL on the same parquet files and report differences."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 7) + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, int):
        return repr(value)
    if hasattr(value, "tzinfo"):
        return str(value.replace(tzinfo=None))
    return str(value)


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def sql_rows(con, text: str) -> tuple[list[str], Counter]:
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def main(folder: str, wanted: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.session import make_session

    spark, con = make_session(), connect(folder)
    fns, texts, bad = queries(), oracle_sql(), 0
    for name in [n for n in fns if not wanted or any(n.startswith(w) for w in wanted)]:
        started = time.time()
        try:
            cols, rows = spark_rows(fns[name](spark, folder))
        except Exception as error:  # noqa: BLE001
            print(f"ERR  {name}: {str(error)[:600]}")
            bad += 1
            continue
        took = time.time() - started
        if name not in texts:
            print(f"rows {name}: {sum(rows.values())} rows, {took:.1f}s")
            continue
        try:
            started = time.time()
            want_cols, want = sql_rows(con, texts[name])
        except Exception as error:  # noqa: BLE001
            print(f"SQL  {name}: {str(error)[:600]}")
            bad += 1
            continue
        ok = cols == want_cols and rows == want
        bad += not ok
        print(f"{'ok  ' if ok else 'DIFF'} {name}: {sum(rows.values())} / {sum(want.values())} rows, {took:.1f}s, sql {time.time() - started:.1f}s", flush=True)
        if not ok:
            print("   columns", cols if cols == want_cols else (cols, want_cols))
            for row, n in list((rows - want).items())[:4]:
                print("   spark", n, row)
            for row, n in list((want - rows).items())[:4]:
                print("   sql  ", n, row)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    sys.exit(main(sys.argv[1], sys.argv[2:]))
