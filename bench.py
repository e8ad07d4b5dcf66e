"""Benchmark: wall time of every registered survey query.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs end to end — survey tables derived from the test tables,
then the operator — and is forced with Spark's ``noop`` sink (the full plan
executes, nothing is collected to the driver).  One warm-up pass of the
flagship query, then ``BENCH_REPS`` (default 3) timed runs per query; the
median is reported.  Prints one JSON line; ``value`` is the sum of medians.

With ``BENCH_STORED=1`` (default) the survey tables are then written once as
parquet partitioned by survey year — the production layout — and every
statistic is timed again over the stored tables (``stored_tables`` in the
output; load/export are I/O jobs and are left out of that pass).

Shuffle bytes per query come from Spark's event log, written to a fresh
scratch folder (``BENCH_EVENT_LOG=0`` turns it off): each run of a query is
tagged with a job group, and the shuffle bytes written by the tasks of that
group's jobs are summed and divided by the number of runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def _open_log(path: str):
    if path.endswith(".zstd"):
        import io

        import zstandard
        return io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(open(path, "rb")))
    return open(path)


def shuffle_bytes(log_dir: str) -> dict[str, int]:
    """Shuffle bytes written per job group, read from the event log files."""
    stage_group: dict[int, str | None] = {}
    total: dict[str, int] = {}
    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(log_dir) for f in fs)
    for path in files:
        if path.endswith((".inprogress", ".crc")) or "appstatus" in os.path.basename(path):
            continue
        with _open_log(path) as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = g
                elif kind == "SparkListenerTaskEnd":
                    g = stage_group.get(ev.get("Stage ID"))
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    if g:
                        total[g] = total.get(g, 0) + int(m.get("Shuffle Bytes Written", 0))
    return total


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from pyspark.sql import SparkSession

    from plotstats.catalog import QUERIES
    from plotstats.plans.session import ADAPTIVE_CONF, ensure_checkpoint_dir

    b = (SparkSession.builder.master(f"local[{cpus}]").appName("plotstats-bench")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "16g")
         .config("spark.sql.shuffle.partitions", str(cpus)))
    for k, v in ADAPTIVE_CONF.items():
        b = b.config(k, v)
    log_dir = None
    if os.environ.get("BENCH_EVENT_LOG", "1") == "1":
        log_dir = tempfile.mkdtemp(prefix="plotstats-events-", dir="/tmp")
        b = (b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false"))
        print(f"event log: {log_dir}", file=sys.stderr)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)

    def run(name: str, group: str) -> float:
        spark.sparkContext.setJobGroup(group, name)
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("tree_summary", "warmup")  # warm-up: JVM, codegen, file listing caches
    timings = {}
    for name in QUERIES:
        if only and name not in only:
            continue
        timings[name] = round(statistics.median(run(name, f"q:{name}") for _ in range(reps)), 3)
        print(f"{name:24s} {timings[name]:7.3f}s", file=sys.stderr)
    stored = {}
    if os.environ.get("BENCH_STORED", "1") == "1":
        # The production layout: survey tables stored as parquet (partitioned
        # by survey year), statistics computed from them.
        from plotstats import catalog
        from plotstats.plans.session import scratch_path
        from plotstats.sources import fixtures as fx
        from plotstats.sources import io

        root = scratch_path(spark, "bench-survey")
        t0 = time.perf_counter()
        io.write_survey_tables(fx.survey_tables(spark, sf_dir), root)
        stored["materialize_sec"] = round(time.perf_counter() - t0, 3)
        tables = io.load_tables(spark, root)
        with catalog.stored_tables(tables):
            q = {}
            for name in QUERIES:
                if name in ("load_tables", "export_results", "row_order_on_load", "workbook_scan") or (only and name not in only):
                    continue
                q[name] = round(statistics.median(run(name, f"s:{name}") for _ in range(reps)), 3)
                print(f"stored {name:17s} {q[name]:7.3f}s", file=sys.stderr)
        stored["queries"] = q
        stored["sum_sec"] = round(sum(q.values()), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    version = spark.version
    spark.stop()
    out = {
        "metric": "sum_of_median_query_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "config": {"cpus": cpus, "reps": reps, "spark": version,
                   "shuffle_partitions": cpus, "aqe": True},
    }
    if stored:
        out["stored_tables"] = stored
    if log_dir:
        shuffle = shuffle_bytes(log_dir)
        out["shuffle_bytes_per_run"] = {n: shuffle.get(f"q:{n}", 0) // reps for n in timings}
        if stored:
            stored["shuffle_bytes_per_run"] = {
                n: shuffle.get(f"s:{n}", 0) // reps for n in stored["queries"]}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
