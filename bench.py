"""Time the headline queries at one scale and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from cohortscale import catalog
from cohortscale.catalog.files import volume_folder
from cohortscale.plans.views import Views
from cohortscale.session import local_session

# One or two per family of operators, the heavy ones among them.
HEADLINE = (
    "E1_by_vendor",
    "E4_detection",
    "E6_auroc",
    "E14_joint_difference",
    "E16_comparison_cube",
    "E20_selection_report",
    "C1_leave_one_vendor_out",
    "C3_expand_to_frames",
    "B2_spacing_plausibility",
    "D1_intensity_window",
    "D7_inverse_regrid",
    "D9_dice",
    "D12_surface",
    "D13_hd95",
    "D20_pass_aggregation",
    "F1_worst_median_best",
    "G1_record_comparison",
    "G3_population_gate",
    "G8_statement_containment",
    "H5_pseudonym_audit",
    "I3_audit_findings",
    "I4_best_and_patience",
    "I8_telemetry_windows_stream",
    "A9_volume_ingest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    seconds, rows = {}, {}
    # The first query would otherwise carry the start of the JVM and the parquet reader.
    spark.read.parquet(f"{folder}/nation.parquet").count()
    # The volume files are there before they are ingested.
    volume_folder(Views(spark, folder))
    for name in names:
        start = time.perf_counter()
        rows[name] = queries[name](spark, folder).count()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {rows[name]} rows {seconds[name]} s", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows": rows,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
