"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`value` is the sum of the seconds of the time-series queries, each the best of
BENCH_RUNS (default 3) after one run to warm up. `derived` has what a comparison
with a compressed-block engine asks for: rows a second of block building, bytes
stored against raw, and rows read by an edge-aware plan against a plain one.
"""

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "all_mean", "range_mean", "range_sum", "range_min", "range_max", "range_count", "range_variance", "mean_where_gt", "count_where_gt", "scan_range_limit", "value_at", "value_at_many", "downsample", "flagship",
    "blocks_mean", "blocks_variance", "two_tier_range_mean", "two_tier_range_variance", "dod_encode", "rle_runs", "quant16", "entropy", "autocorr", "manifest_mean", "partition_mean",
]


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tideblock.model import Options
    from tideblock.operators import blocks as B
    from tideblock.plans import registry

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()

    def timed(f) -> float:
        start = time.perf_counter()
        f().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        run = lambda name=name: queries[name](spark, SF_DIR)
        timed(run)
        seconds[name] = round(min(timed(run) for _ in range(RUNS)), 4)

    rows = registry.blocked_rows(spark, SF_DIR)
    build = timed(lambda: B.build_blocks(rows, Options(epsilon=0.01), ["value"]))
    sizes = B.encode_blocks(rows, Options(epsilon=0.01), ["value"]).agg(F.sum("n_bytes")).first()[0]
    plain = registry.queries()["range_mean"](spark, SF_DIR).first()
    from tideblock.plans import two_tier

    edge = two_tier.two_tier(rows, registry.stats_table(spark, SF_DIR), "mean", "value", registry.LO_NS, registry.HI_NS).first()
    n = rows.count()
    derived = {
        "block_build_sec": round(build, 3), "block_build_rows_per_sec": round(n / build), "ratio_values": round(8 * n / sizes, 2), "rows_touched_plain": plain["rows_scanned"],
        "pct_rows_touched_two_tier": round(edge["pct_data_read"], 3), "pct_answered_from_statistics": round(edge["pct_algebraic"], 3),
    }
    print(json.dumps({"metric": "sum of best seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")), "derived": derived}))
    spark.stop()


if __name__ == "__main__":
    main()
