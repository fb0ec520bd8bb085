"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.

The scored table (population -> features -> scorecard) is built once and
written to the shared checkpoint folder, as the dashboard reads its scored
file; its build time is reported as ``base_build``. Every query is then forced end to end with the ``noop``
sink (full computation, nothing shipped to the driver). Four model fits
this scale factor; ``fit_all_published_sizes`` fits all five models at their published sizes.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q_employee_table", "q_features", "q_kpis", "q_risk_by_department", "q_rate_all_dims",
    "q_pivot_dept_gender", "q_pivot_band_shift", "q_segment_spread", "q_describe", "q_corr_with_prob",
    "q_hist_prob_by_leaving", "q_lookup_top200", "q_persona_dashboard", "q_auc", "q_roc_curve",
    "q_classification_report", "q_stratified_split", "q_standard_scale", "q_risk_factors",
    "q_profile_scores", "q_trailing_event_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from retentia.operators import models as MD
    from retentia.operators.trees import TreeRule
    from retentia.plans.catalog import QUERIES
    from retentia.session import local_session
    from retentia.sources.tables import feature_table, lookup_table, scored_table

    spark = local_session(cpus, app="retentia-bench")
    times: dict[str, float] = {}

    def timed(name, run):
        t = time.time()
        out = run()
        times[name] = round(time.time() - t, 3)
        return out
    timed("base_build", lambda: scored_table(spark, sf_dir).write.format("noop").mode("overwrite").save())
    timed("lookup_build", lambda: lookup_table(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda name=name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())

    # model fits on the encoded feature matrix: the sizes of BASELINE's fit-time guide, then all five models at the published sizes
    prep = MD.prepare(feature_table(spark, sf_dir))
    prep.data.write.format("noop").mode("overwrite").save()
    timed("bin_matrix", lambda: MD._binned(prep))
    full = {s.name: s for s in MD.model_specs(MD.Sizes.full())}
    guide = {
        "fit_logistic": full["Logistic Regression"],
        "fit_tree_d8": full["Decision Tree"],
        "fit_gbt_20x5": MD.ModelSpec("boosting", False, False, rule=TreeRule("residual", 20, 5, 1, False, rate=0.05, subsample=0.8)),
        "fit_forest_30x12": MD.ModelSpec("forest", False, True, rule=TreeRule("gini", 30, 12, 10, True, n_features=0, bootstrap=True)),
    }
    for name, spec in guide.items():
        timed(name, lambda spec=spec: MD.fit_many([spec], prep, [None]))
    timed("fit_all_published_sizes", lambda: MD.fit_many(list(full.values()), prep, [None]))

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
