"""Runs a query beside its SQL on the same tables and compares rows as multisets."""

from __future__ import annotations

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata")


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted((DATA / sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def differences(spark, name: str, sf: str, say: bool = False) -> list[str]:
    import __spark_entry__ as e

    df = e.queries()[name](spark, str(DATA / sf))
    cols = sorted(df.columns)
    own = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = connect(sf).sql(e.oracle_sql()[name])
    theirs_cols = sorted(rel.columns)
    if cols != theirs_cols:
        return [f"{name}: columns {cols} / {theirs_cols}"]
    at = [rel.columns.index(c) for c in cols]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    out = [f"{name}: {sum(own.values())} / {sum(theirs.values())} rows"] if own != theirs else []
    out += [f"  only Spark {x}" for x in list((own - theirs))[:3]] + [f"  only SQL {x}" for x in list((theirs - own))[:3]]
    if say:
        print(f"{name}: {sum(own.values())} rows", "ok" if not out else out, flush=True)
    return out


if __name__ == "__main__":
    from landloom.session import local_session

    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    todo = sys.argv[2:] or [q for q in entry.queries() if q in entry.oracle_sql()]
    bad = 0
    for q in todo:
        try:
            bad += bool(differences(session, q, sys.argv[1], True))
        except Exception as err:  # noqa: BLE001
            bad += 1
            print(q, "FAILED", str(err)[:600], flush=True)
    print("bad:", bad)
