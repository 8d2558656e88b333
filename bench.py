"""Time the headline queries and print one JSON line.

Every query is run whole into a no-op sink: once to warm the JVM, then timed.
"""

from __future__ import annotations

import json
import os
import time

from cohortline.queries import REGISTRY
from cohortline.session import local_session

HEADLINE = (
    "run_episodes",
    "stay_builder",
    "cohort_funnel",
    "funnel_attrition",
    "first_row_per_key",
    "outside_interval",
    "interval_join_24h",
    "worst_values_wide",
    "infusion_exposure",
    "bolus_vs_continuous",
    "unit_normalize",
    "daily_rollup",
    "first_measure",
    "threshold_flags",
    "indicator_matrix",
    "code_set_matrix",
    "class_matrix",
    "supplement_merge",
    "exposure_group",
    "id_batches",
    "group_summary",
    "table_one",
    "ttest_stats",
    "mannwhitney_u",
    "chi2_stat",
    "group_compare",
    "study_demographics",
)

# Timed as well, beside the headline total.
REPORTS = ("normality", "ttest_intervals", "group_compare_by_nation", "study_report")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    timings = {}
    for name in (*HEADLINE, *REPORTS):
        for _ in range(2):
            start = time.perf_counter()
            REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, second run of each",
                "value": round(sum(timings[name] for name in HEADLINE), 3),
                "unit": "sec",
                "queries": {name: timings[name] for name in HEADLINE},
                "reports": {name: timings[name] for name in REPORTS},
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
