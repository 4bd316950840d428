"""Runs queries and their SQL side by side. python -m tests.oracle [sf] [name ...]"""

import sys
import time
import traceback

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(str, r)) for r in frame.where(frame.notna(), None).values.tolist()))


def compare(spark, c, sf_dir: str, query, oracle: str) -> tuple[str, int]:
    """What differs, or nothing; and the number of rows."""
    mine, theirs = query(spark, sf_dir).toPandas(), c.sql(oracle).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} and {sorted(theirs.columns)}", len(mine)
    a, b = rows_of(mine), rows_of(theirs)
    if a == b:
        return "", len(a)
    first = next(((x, y) for x, y in zip(a, b) if x != y), (len(a), len(b)))
    return f"{len(a)} and {len(b)} rows; {sum(x != y for x, y in zip(a, b))} differ, first {first}", len(a)


def shuffled_rows(frame) -> int:
    """Rows that the plan's exchanges write while frame is run."""
    store = frame.sparkSession.sparkContext._jsc.sc().statusStore()
    none, sizes = frame.sparkSession._jvm.java.util.ArrayList(), frame.sparkSession.sparkContext._gateway.new_array(frame.sparkSession._jvm.double, 0)

    def written():
        stages = store.stageList(none, False, False, sizes, none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    frame.write.mode("overwrite").format("noop").save()
    return written() - before


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from lexshift.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark, c = local_session(8, 8), connection(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or queries():
        t = time.time()
        try:
            if name in oracle_sql():
                said, n = compare(spark, c, sf_dir, queries()[name], oracle_sql()[name])
            else:
                said, n = "no SQL", queries()[name](spark, sf_dir).count()
            print(f"{name}: {said or 'same'} ({n} rows, {time.time() - t:.1f} s)", flush=True)
        except Exception:
            print(f"{name}: FAILED {traceback.format_exc()[-700:]}", flush=True)
