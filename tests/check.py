"""Run queries against their oracle: python tests/check.py SF_DIR [names...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from martlet.session import local_session  # noqa: E402
from martlet.workload.registry import load  # noqa: E402
from martlet.workload.views import TABLES  # noqa: E402


def oracle_rows(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return names, result.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def key(row):
        return tuple((v is None, type(v).__name__ if v is None else "", repr(v)) for v in row)
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=key)


def compare(name, df, sf_dir, sql):
    """None when equal, else a line saying how they differ."""
    got_names, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    want_names, want = canonical(*oracle_rows(sf_dir, sql))
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}" if bad else None


if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    registered = load()
    failed = 0
    for name, (run, sql) in registered.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if sql is None:
                verdict = f"rows only: {len(df.collect())}"
            else:
                problem = compare(name, df, sf_dir, sql)
                verdict = "ok" if problem is None else "DIFF " + problem
        except Exception as e:  # report and go on
            verdict = "ERROR " + str(e)[:600]
        failed += verdict.startswith(("DIFF", "ERROR"))
        print(f"{time.time() - start:6.1f}s {name}: {verdict}", flush=True)
    print("failed:", failed)
