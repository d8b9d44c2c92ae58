"""Times the headline queries: one JSON line on stdout.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is run to completion over its whole result (noop sink), after one
small query that starts the engine.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slotwise.plans import QUERIES  # noqa: E402
from slotwise.session import local_session  # noqa: E402

HEADLINE = [
    "ts_clean", "ts_delta", "ts_trips", "ts_hour_weekday_avg", "ts_half_hour", "ts_gap_fill",
    "ts_avail_hour", "ts_avail_station", "ft_join", "bl_historical_mode", "bl_seasonal_naive",
    "q_baseline_scores", "rf_features_train",
    "q_view_report", "q_top_company_avg", "q_companies_above_avg", "q_card_status", "q_product_sales",
    "q_salary_summary", "q_market_heatmap",
    "txt_word_count", "txt_index_by_initial", "rsh_league_table", "st_describe", "st_box", "dq_impute_median",
    "geo_within_left_join", "rt_best_origin",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    QUERIES["src_parquet"](spark, sf_dir).collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
