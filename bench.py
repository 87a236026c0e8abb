"""Time the headline queries: BENCH_SF_DIR (default sf0.1), local[BENCH_CPUS]. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from saldo.catalog import load  # noqa: E402
from saldo.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_unexplained_copago", "p01_item_classes", "a04_settlement_totals", "a06_control_table", "q05_where_and_how_much", "j01_amount_match",
    "j04_containment_match", "j08_contiguous_match", "p24_candidate_score", "j11_subset_match", "j05_rule_by_affinity", "p25_motors", "w04_episode_numbers",
    "a24_account_signals", "j22_tiered_decision", "a14_balance_by_capability", "a17_family_netting", "a18_subsumption", "j34_column_check", "a55_repeated_phrases",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "saldo-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    queries["a01_page_totals"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t = time.time()
        try:
            queries[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # a failed query must not hide the others
            print(f"{n}: {str(e)[:300]}", file=sys.stderr)
            continue
        times[n] = round(time.time() - t, 3)
        print(n, times[n], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
