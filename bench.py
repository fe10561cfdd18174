"""Time the headline queries and print one JSON line.

Each query is run to completion into the no-op sink, so every row and payload is computed and
nothing is collected.  ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from workloads import registry  # noqa: E402

HEADLINE = [
    "affine_pixel_to_map",
    "grid_tiles",
    "scene_tile_overlap",
    "scenes_per_tile",
    "block_cells",
    "mosaic_forward",
    "mosaic_forward_windowed",
    "mosaic_inverse",
    "mosaic_multiband",
    "tile_percentile_cuts",
    "stretch_8bit",
    "scene_stretch_bands",
    "tile_payload_raw",
    "tile_payload_png",
    "tiles_dense",
    "tile_lookup",
    "pyramid_inverse_png",
    "pyramid_report",
]


def session(cpus: int) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tilepyramid-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall-clock",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
