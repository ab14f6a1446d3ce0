"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"

HEADLINES = (
    "summary_by_utc_day", "sweep_report", "latest_result_per_model", "sweep_ordinals", "nearby_band_join", "neighbors_prev_next", "review_default", "review_partial_agreement",
    "search_any_scope", "scoring_normalize", "evidence_normalize", "exact_groups", "agreement_summary", "near_groups", "utterance_agreement", "eval_model_metrics", "quality_flags", "scan_lifecycle",
)


def main() -> None:
    from squelch.plans.catalogue import QUERIES
    from squelch.session import local_session

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    QUERIES["status_matrix"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the JVM's engines
    took = {}
    for name in HEADLINES:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
