"""Time headline queries and print one JSON line.

Every query starts from the source tables: stage tables kept by earlier queries
are forgotten first.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from spotfield.catalog.queries import QUERIES
from spotfield.sources.study import close_studies

HEADLINE = [
    "score_bounded", "score_all_ligands", "qc_supplier", "genes_detected", "pair_eligibility_states", "fdr_bh", "threshold_q99",
    "folds_checkerboard", "range_decision", "evidence_specificity", "robust_response", "contact_edges", "contact_exposure",
    "raster_stains", "raster_blur", "raster_otsu", "tissue_area", "raster_tensor", "mesh_summary", "mesh_diameter", "locate_points",
    "deposit", "fem_checks", "exposure_mass_law", "covariance_fit", "bootstrap_p", "flow_secreted", "flow_contact", "flow_range",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times = {}
    for name in only:
        close_studies(spark)
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
