"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "flagship_model_error_by_region_season", "a03_heat_excess_trapezoid", "a05_heat_excess_layers", "a08_layer_depths",
    "j01_nearest_cell", "j03_idw_sample", "j04_support_join", "j05_nearest_support_km", "j12_neighbourhood_wide",
    "j13_gradient_per_100km", "j17_gaussian_grid", "g02_grouped_metrics", "g06_delta_statistics", "g07_box_stats",
    "g17_seasonal_mean_field", "g22_error_cdf", "g29_cluster_bootstrap_ci_1000", "e01_forward_folds", "m08_recipe_ablation",
]


def main() -> None:
    from isotherma.plans import CATALOG
    from isotherma.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start the workers
    times = {}
    for name in names:
        start = time.perf_counter()
        CATALOG[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
