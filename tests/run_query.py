"""Run queries of the entry module and compare them with their SQL: python tests/run_query.py SF_DIR NAME..."""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def cell(x):
        if isinstance(x, float):
            return f"{x:.9g}"
        return str(list(x)) if isinstance(x, (list, tuple)) else str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main(sf, names):
    import duckdb

    import __spark_entry__ as E
    from scholiast.runtime import build_session

    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    queries, sql = E.queries(), E.oracle_sql()
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            rows = df.collect()
            took = time.time() - t
            if name in sql:
                cur = con.execute(sql[name])
                want, cols = cur.fetchall(), [c[0] for c in cur.description]
                same = sorted(df.columns) == sorted(cols) and normal(rows, df.columns) == normal(want, cols)
                print(name, len(rows), "OK" if same else f"DIFFERS {len(want)} {cols}", f"{took:.1f}s")
                if not same:
                    a, b = normal(rows, df.columns), normal(want, cols)
                    print("  only spark:", [x for x in a if x not in set(b)][:3])
                    print("  only sql:", [x for x in b if x not in set(a)][:3])
            else:
                print(name, len(rows), "no sql", f"{took:.1f}s", rows[:2])
        except Exception as e:
            print(name, "ERROR", str(e)[:600])


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
