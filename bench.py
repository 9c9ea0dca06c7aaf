"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tablewarden.plans import registry  # noqa: E402
from tablewarden.session import local_session  # noqa: E402

HEADLINES = [
    "x01_fused_suite", "r22_compound_unique", "r33_median_between", "r40_increasing", "r42_z_scores", "g03_validate_all_partitions",
    "g03_validate_lineitem_by_month", "g10_partition_verdicts", "p01_counts", "p03_masks", "p05_numeric", "p07_frequency", "p14_full_stats",
    "p17_duplicate_rows", "p19_pearson", "p20_spearman", "p24_fingerprint", "c02_regex_rates_columns", "c02_regex_rates_text", "c23_egypt_nid",
    "c31_check_rates_all_columns", "c38_verdict_balanced", "t01_regex_spans", "t02_entity_counts", "t15_overlap_clusters", "t17_resolve_overlaps",
    "t18_text_windows", "k01_apply_plan", "k05_keyed_hash", "k15_fake_digits", "k24_deid_text", "e02_overlap_match", "e05_graded_outcomes",
    "n01_nearest_cosine", "v01_column_drift", "v09_scrub_text",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registry.load_all()
    spark = local_session(cpus, "bench")
    lineitem = f"{sf_dir}/lineitem.parquet"
    spark.read.parquet(lineitem).agg(F.count(F.lit(1))).collect()      # warm the engine, not the queries
    # yardstick: a plain count and sixteen sums over the same table
    numbers = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    times: dict[str, float] = {}
    t0 = time.time()
    run(spark.read.parquet(lineitem).agg(F.count(F.lit(1)), *[F.sum(F.col(c) * i).alias(f"{c}{i}") for c in numbers for i in range(1, 5)]))
    times["plain_scan_16_sums"] = round(time.time() - t0, 3)
    for name in HEADLINES:
        t0 = time.time()
        run(registry.QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(v for k, v in times.items() if k != "plain_scan_16_sums"), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
