"""Benchmark the headline queries: ONE JSON line on stdout.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, optional),
     BENCH_EVENT_LOG_DIR (optional: write Spark's event log there for stage/task timings; no UI is started)
Each query is fully executed with the ``noop`` sink (no driver collect) and timed wall-clock.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "parse_type", "consistent_types", "grouped_levels_typed", "risk_factors_long", "wide_table",
    "contingency_typed", "chisq_segment", "crosstab_chisq", "fisher_pvalue_segment", "fisher_exact_segment",
    "logit_grid", "deviance_grid", "standardised_risk_effects", "meta_regions", "cohort_entry_censor",
    "basic_time_to_event", "competing_risk_records", "fine_gray_intubation", "bootstrap_risk_ci",
    "corr_lineitem", "race_consensus", "first_order_per_customer", "histogram_event_value",
    "stratified_logit_strata", "chisq_sites_regions", "overall_summary_events", "partition_counts_orders",
    "risk_grid_bootstrap",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    from cohortlab.session import get_spark
    from cohortlab.plans import catalog

    extra = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")}
    if os.environ.get("BENCH_EVENT_LOG_DIR"):
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG_DIR"]})
    spark = get_spark(f"local[{cpus}]", cpus, app="cohortlab-bench", extra=extra)
    qs = catalog.queries()
    # warm-up: JVM, parquet footer cache, codegen
    spark.read.parquet(os.path.join(sf_dir, "customer.parquet")).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        try:
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001
            print(f"[bench] {name} failed: {type(e).__name__}: {str(e)[:300]}", file=sys.stderr)
            times[name] = None
        print(f"[bench] {name}: {times[name]}", file=sys.stderr)
    total = round(sum(v for v in times.values() if v is not None), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_clock_headline_queries", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
