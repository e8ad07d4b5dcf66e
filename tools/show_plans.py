"""Print the final (adaptive) physical plan of registered queries.

    python tools/show_plans.py [--stored] [--no-broadcast] [--sf DIR] name [name ...]

With ``--stored`` the survey tables are first written as parquet
(partitioned by survey year) to a fresh scratch folder and the queries run
over them — the production layout.  Each query is executed (noop sink is not
used, the result is collected) so the plan shown is AQE's final plan.  With
``--no-broadcast`` no side is broadcast by its size, as at a scale where none
is small enough.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def compact(plan: str) -> str:
    out = []
    for line in plan.splitlines():
        if "== Initial Plan ==" in line:
            break
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r", \[plan_id=\d+\]", "", line)
        line = re.sub(r"Location: InMemoryFileIndex\(\d+ paths\)\[[^\]]*\]", "", line)
        out.append(line[:200])
    return "\n".join(out)


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="+")
    ap.add_argument("--stored", action="store_true")
    ap.add_argument("--no-broadcast", action="store_true")
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    a = ap.parse_args()

    from plotstats import catalog
    from plotstats.plans.session import scratch_path, tuned_session
    from plotstats.sources import fixtures as fx
    from plotstats.sources import io

    spark = tuned_session()
    if a.no_broadcast:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(key, "-1")
    ctx = None
    if a.stored:
        root = scratch_path(spark, "plans")
        io.write_survey_tables(fx.survey_tables(spark, a.sf), root)
        ctx = catalog.stored_tables(io.load_tables(spark, root))
        ctx.__enter__()
    for name in a.names:
        df = catalog.QUERIES[name](spark, a.sf)
        df.collect()
        print(f"### {name}\n")
        print(compact(df._jdf.queryExecution().executedPlan().toString()))
        print()
    if ctx:
        ctx.__exit__(None, None, None)


if __name__ == "__main__":
    main()
