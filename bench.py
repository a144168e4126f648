"""Times the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["flt_nested_groups", "flt_regex", "cnt_matches", "sort_window", "search_documents", "search_variant", "prof_top10", "profile_lineitem", "prof_nested", "schema_orders", "diff_enum", "vis_form", "gen_sql_exec", "exp_ndjson"]


def main() -> None:
    from rowscope.queries import QUERIES
    from rowscope.session import session

    spark = session(f"local[{CPUS}]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["flt_eq_str"](spark, SF_DIR).count()
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            t = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - t)
        took[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
