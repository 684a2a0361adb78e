"""Run registered queries next to their SQL oracles and compare the results."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


# Entries without an oracle and the tests that hold their operators against closed forms. Any other entry
# without an oracle fails.
UNIT_TESTED = {
    "provider_classifier": "tests/test_prediction.py", "method_sweep_pca": "tests/test_similarity.py",
}


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in value.items()))
    return value if isinstance(value, int) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(repr, t))
    )


def oracle_connection(folder):
    import duckdb

    from turfline.plans.views import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, folder, name, entry):
    from turfline.plans.views import Views

    started = time.time()
    df = entry.run(Views(spark, folder))
    got = df.collect()
    took = time.time() - started
    if entry.sql is None:
        return f"no oracle, {len(got)} rows; held by {UNIT_TESTED.get(name, 'nothing')}", took, name in UNIT_TESTED
    started = time.time()
    cur = con.execute(entry.sql)
    columns = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    oracle = time.time() - started
    if sorted(df.columns) != sorted(columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(columns)}", took, False
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(columns, want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"DIFF rows {len(a)} vs {len(b)} {sorted(columns)} {bad}", took, False
    odd = {
        c: (t, types[c]) for c, t in df.dtypes if TYPES.get(t, t) != types[c] and types[c] != "NUMBER"
    }
    note = f" types {odd}" if odd else ""
    return f"ok {len(a)} rows (oracle {oracle:.1f}s){note}", took, True


def main():
    from turfline.plans import load_entries
    from turfline.session import local_session

    args = sys.argv[1:]
    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    entries = load_entries()
    names = [n for n in entries if not args or any(n.startswith(a) for a in args)]
    spark, con, failed = local_session("8", "check"), oracle_connection(folder), []
    for name in names:
        try:
            note, took, ok = compare(spark, con, folder, name, entries[name])
        except Exception as e:  # noqa: BLE001
            note, took, ok = f"ERROR {type(e).__name__}: {str(e)[:1500]}", 0.0, False
        print(f"{'PASS' if ok else 'FAIL'} {name:34s} {took:6.2f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} passed", failed)
    spark.stop()


if __name__ == "__main__":
    main()
