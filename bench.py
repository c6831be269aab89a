"""Times the headline queries at $BENCH_SF_DIR and prints one JSON line.

A small job starts the session first, so no query bears that.  Of families that repeat the same work (run
lengths, morphology, registration, streams) one or two queries stand for all; REPEATED names those left out.
"""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from voxelframe.plans import catalogue

REPEATED = set(
    "erl_runs erl_total_tolerant erl_subset erl_report neuron_report labelmap_nodes chain_enumerate chains_first_n anchor_node chain_window "
    "mask_open_close mask_smooth mask_holes mask_largest mask_islands box_from_mask qc_signals anchor_gate fallback_policy anchor_select "
    "registration_fill registration_smooth registration_scale registration_apply chain_prompts residual_coherence composite_max pending_unclaimed "
    "triage_stream events_window review_sessions ab_winners measurement_log".split()
)

if __name__ == "__main__":
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    took = {}
    for name, f in catalogue.queries().items():
        if name in REPEATED:
            continue
        start = time.time()
        f(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
