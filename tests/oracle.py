"""Compare queries with their SQL twins: python tests/oracle.py SF_DIR [NAME...]."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{round(x, 6) + 0.0:.6f}"
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return x


def difference(spark, con, sf_dir, query, sql):
    """None, or what differs."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((repr([plain(x) for x in (r.asDict(True)[c] for c in cols)]) for r in df.collect()))
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted(repr([plain(r[i]) for i in order]) for r in cur.fetchall())
    if got != want:
        g, w = [x for x in got if x not in set(want)], [x for x in want if x not in set(got)]
        return f"{len(got)} rows against {len(want)}; {len(g)} differ: {g[:3]} | {w[:3]}"
    return None


def main(sf_dir, *names):
    import __spark_entry__ as entry
    from tests.session import session

    spark, con = session(), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for n in names or [q for q in queries if q.startswith("q_")]:
        t = time.time()
        if n in oracle:
            try:
                d = difference(spark, con, sf_dir, queries[n], oracle[n])
            except Exception as e:
                d = f"{type(e).__name__} {str(e)[:600]}"
            print(f"{'ok  ' if d is None else 'DIFF'} {n} {time.time() - t:.1f}s {d or ''}", flush=True)
        else:
            print(f"rows {n} {queries[n](spark, sf_dir).count()} {time.time() - t:.1f}s", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
