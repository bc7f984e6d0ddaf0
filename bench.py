"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compindex.session import local_session  # noqa: E402
from compindex.workload import catalogue  # noqa: E402

HEADLINE = (
    "composite_rank", "locked_composite_rank", "latest_value", "anchor_scale", "winsor_minmax", "domain_mean",
    "debias_arms", "event_exposure", "volatility", "channel_share", "reference_screen", "spearman", "kendall_and_gamma",
    "eta_squared", "bh_fdr", "group_profile", "ecdf_divergence", "band_gi_star", "inverse_distance_moran", "queen_moran",
    "point_in_polygon", "nearest_neighbours", "kde_grid", "local_moran", "mc_rank_bands", "scenario_rescore",
    "resolve_names", "register_upsert", "table_diff", "upsert_series",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="compindex-bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["latest_value"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
