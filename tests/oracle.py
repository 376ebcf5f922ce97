"""Compare registered queries with their SQL twins: python tests/oracle.py [sf_dir] [name ...]"""
from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "nan" if math.isnan(v) else repr(v + 0.0))
    return (3, type(v).__name__ + ":" + str(v))


def compare(con, df, sql: str) -> str | None:
    """None when equal, else what differs."""
    cols = sorted(df.columns)
    got = sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted(tuple(_cell(r[i]) for i in at) for r in cur.fetchall())
    if got != want:
        extra = [g for g in got if g not in set(want)][:2]
        lack = [w for w in want if w not in set(got)][:2]
        return f"rows {len(got)} against {len(want)}; only Spark {extra}; only SQL {lack}; columns {cols}"
    return f"no rows" if not got else None


def main(argv):
    sf = argv[0] if argv and "/" in argv[0] else "/root/testdata/sf0.01"
    names = [a for a in argv if "/" not in a]
    import __spark_entry__ as entry
    from tidegate.session import build_session
    spark = build_session("oracle", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con, q, o, bad = connect(sf), entry.queries(), entry.oracle_sql(), 0
    for name in names or sorted(q):
        t = time.time()
        try:
            if name in o:
                diff = compare(con, q[name](spark, sf), o[name])
            else:
                diff = None if q[name](spark, sf).count() else "no rows"
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} {time.time() - t:.1f}s {diff or ''}{'' if name in o else ' (rows only)'}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
