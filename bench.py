"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each job runs once to warm up, then three times; the median is reported. Query
jobs are forced with the ``noop`` sink (all rows computed, nothing collected);
export jobs are timed through their real sink into a fresh folder.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    from pyspark.sql import functions as F

    from haulage.operators import columns as B
    from haulage.operators import keyed as D
    from haulage.operators import paging as P
    from haulage.operators import tasks as T
    from haulage.plans import catalog
    from haulage.plans.export import scratch_folder
    from haulage.session import get_session
    from haulage.sinks import archive as Z
    from haulage.sinks import writers as E
    from haulage.specs import ColumnSpec as S
    from haulage.streaming import notify as G

    spark = get_session(f"local[{CPUS}]", conf={
        "spark.sql.shuffle.partitions": str(int(CPUS) * 2),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")

    def t(name):
        return spark.read.parquet(f"{SF_DIR}/{name}.parquet")

    specs = [S(name="order", column=0, change_order=3), S(name="qty", column=4), S(column=10, change_order=0)]

    def shaped():
        return B.apply_specs(t("lineitem"), specs)

    def noop(make):
        return lambda: make().write.format("noop").mode("overwrite").save()

    def sink(writer):
        return lambda: writer(shaped(), scratch_folder(spark, "bench"))

    jobs = {
        "apply_specs_csv": sink(E.write_csv),
        "apply_specs_json": sink(E.write_json),
        "apply_specs_zip": sink(Z.write_zip),
        "apply_specs_xlsx": sink(Z.write_xlsx),
        "with_page": noop(lambda: P.with_page(t("lineitem"), t("lineitem").columns, 10)),
        "page_deep": noop(lambda: P.page(t("orders"), ["o_orderkey"], 100, 1200, method="numbered")),
        "upsert": noop(lambda: D.upsert(
            D.upsert(None, t("events").filter(F.col("ts") < F.lit(catalog.CUTOFF).cast("timestamp_ntz")),
                     ["user_id"], "event_id"),
            t("events").filter(F.col("ts") >= F.lit(catalog.CUTOFF).cast("timestamp_ntz")),
            ["user_id"], "event_id")),
        "upsert_store": noop(lambda: catalog.QUERIES["d10_upsert_store"](spark, SF_DIR)),
        "latest_status": noop(lambda: T.latest_status(T.task_events(t("events")))),
        "cancel_outcomes": noop(lambda: T.cancel_outcomes(T.task_events(t("events")))),
        "fan_out": noop(lambda: G.fan_out(G.messages(t("events")),
                                          t("region").select(F.col("r_name").alias("subscriber")))),
        "flagship": noop(lambda: catalog.flagship(spark, SF_DIR)),
    }
    for name, fn in catalog.QUERIES.items():
        if name.startswith("h"):
            jobs[name] = noop(lambda fn=fn: fn(spark, SF_DIR))

    results = {}
    for name, job in jobs.items():
        job()  # warm-up
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            job()
            times.append(time.perf_counter() - start)
        results[name] = round(statistics.median(times), 3)
        print(f"{name}: {results[name]}s", file=sys.stderr, flush=True)

    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_job_seconds", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": sf, "cpus": int(CPUS), "runs": RUNS}))


if __name__ == "__main__":
    main()
