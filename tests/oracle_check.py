"""Run registered queries against their SQL twins: python tests/oracle_check.py FOLDER [NAME...]."""

import hashlib
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return f"{v:.6g}"
        if hasattr(v, "isoformat"):
            return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
        return str(v)

    return sorted("\x1f".join(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, run, sql):
    t = time.time()
    df = run(spark, folder)
    ours = canonical([tuple(r) for r in df.collect()], df.columns)
    took, t = time.time() - t, time.time()
    rel = con.execute(sql)
    theirs = canonical(rel.fetchall(), [d[0] for d in rel.description])
    same = ours == theirs and sorted(df.columns) == sorted(d[0] for d in rel.description)
    digest = hashlib.md5("\n".join(ours).encode()).hexdigest()[:8]
    diff = "" if same else f"\n   only ours: {sorted(set(ours) - set(theirs))[:2]}\n   only theirs: {sorted(set(theirs) - set(ours))[:2]}"
    return same, f"{name}: {'same' if same else 'DIFFERENT'} {len(ours)}/{len(theirs)} {digest} {took:.1f}s sql {time.time() - t:.1f}s{diff[:1500]}"


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        path = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{path}'")
    return con


if __name__ == "__main__":
    from conftest import session

    import __spark_entry__ as e

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con, sql = session(), connect(folder), e.oracle_sql()
    for name, run in e.queries().items():
        if name in sql and (not names or name in names):
            try:
                print(compare(spark, con, folder, name, run, sql[name])[1], flush=True)
            except Exception as x:  # noqa: BLE001
                print(f"{name}: ERROR {str(x)[:600]}", flush=True)
