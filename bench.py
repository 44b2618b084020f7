"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each
query runs once to warm the session and is then timed; results are written to a no-op sink, so
every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from statewatch.session import local_session  # noqa: E402

HEADLINE = [
    "a01_additive_state", "a01_additive_state_narrow", "a11_ledoit_wolf", "a13_mmd2", "a15_marginal_gap", "a16_parity_scan",
    "c01_class_contrast", "c02_score_effect", "c15_helstrom_rule", "c16_pretty_good_rule",
    "f08_pair_equality", "f11_paired_contrast", "f12_grid_pair_stats", "f17_window_features_spatial",
    "i03_bootstrap_risk", "i07_paired_bootstrap", "i07_paired_bootstrap_in_place", "l01_template_loglik", "l04_chain_increments", "l08_bernoulli_score",
    "r01_shot_alerts", "r02_select_threshold", "r04_shot_report", "r07_risk_at_budget", "r09_delay_summary", "r15_evaluate",
    "s06_difference_events", "s09_pair_blocks", "t01_contrast_eprocess", "t02_simplex_witness", "t06_bounded_sr",
    "t12_ewma_topk", "t14_online_logistic", "t15_eprocess_bank", "t17_page_cusum", "t19_score_bank", "t20_shot_eprocess",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    from statewatch import catalog

    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        for run in ("warm", "timed"):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            if run == "timed":
                times[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
