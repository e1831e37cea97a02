"""Compare registered queries with their SQL on one scale factor: python tools/check.py DIR [name ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from omicframe.plans import ORACLES, QUERIES  # noqa: E402
from omicframe.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float):
            return round(v, 9) + 0.0
        if isinstance(v, list):
            return tuple(cell(x) for x in v)
        if isinstance(v, pd.Timestamp):
            return str(v)[:10] if v == v.normalize() else str(v)
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return v

    cols = sorted(df.columns)
    return sorted((tuple(cell(v) for v in r) for r in df[cols].astype(object).values.tolist()), key=repr)


def same(a: list[tuple], b: list[tuple]) -> str | None:
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y and repr(x) != repr(y)]
    return f"{len(bad)} of {len(a)} rows differ, first: {bad[0]}" if bad else None


def main() -> int:
    sf = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    spark = local_session(8)
    failed = 0
    for name in names:
        try:
            t0 = time.time()
            res = QUERIES[name](spark, sf)
            got = res.toPandas()
            t1 = time.time()
            if name in ORACLES:
                want = con.execute(ORACLES[name]).df()
                if sorted(got.columns) != sorted(want.columns):
                    problem = f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
                else:
                    problem = same(normal(got), normal(want))
            else:
                problem = None
            state = "ok" if problem is None else "DIFF"
            failed += problem is not None
            print(
                f"{state:5s} {name:32s} rows={len(got):7d} spark={t1 - t0:6.2f}s duck={time.time() - t1:6.2f}s"
                f"{'' if name in ORACLES else ' (no sql)'} {problem or ''}",
                flush=True,
            )
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
