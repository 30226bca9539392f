"""Headline timings as one JSON line.

    BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)

Every query is run to completion (all rows computed, none fetched). The first
fit of each kind includes JVM, code generation and Python worker start-up; the
headline value is the second fit. Spark's own ALS is timed the same two ways.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from ridgeline import ALSFactorizer  # noqa: E402
from ridgeline import workdir  # noqa: E402
from ridgeline.plans import queries as q  # noqa: E402
from ridgeline.plans.derive import order_ratings  # noqa: E402
from ridgeline.sources import dense, headered  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run_all(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = workdir.new_run_dir(spark, "bench")
    seconds, facts = {}, {}

    def timed(name, work):
        started = time.perf_counter()
        result = work()
        seconds[name] = round(time.perf_counter() - started, 3)
        return result

    timed("load_ratings", lambda: order_ratings(spark, SF_DIR).write.parquet(f"{run}/ratings"))
    ratings = spark.read.parquet(f"{run}/ratings")

    # The published configuration: 5 features, 7 iterations, lambda 0.05.
    published = dict(rank=5, reg=0.05, max_iter=7)
    model = timed("als_fit", lambda: ALSFactorizer(**published).fit(ratings))
    row = timed("evaluate", lambda: model.evaluate(ratings).first())
    facts["mse"], facts["rmse"], facts["ratings"] = row["mse"], row["rmse"], row["n"]
    timed("als_fit_warm", lambda: ALSFactorizer(**published).fit(ratings))
    timed("als_fit_blocks", lambda: ALSFactorizer(**published, strategy="blocks").fit(ratings))
    timed("als_fit_blocks_warm", lambda: ALSFactorizer(**published, strategy="blocks").fit(ratings))
    timed("als_fit_shuffle", lambda: ALSFactorizer(**published, strategy="shuffle").fit(ratings))
    timed("objective", lambda: model.objective(ratings).first())
    timed("recommend_top10", lambda: run_all(model.recommend(10)))
    timed("recommend_grid", lambda: run_all(model.recommend(10, broadcast_limit=0)))

    timed("predict_rows", lambda: run_all(model.predict_rows()))

    def headered_round_trip():
        headered.write_headered_ratings(ratings, f"{run}/headered")
        run_all(headered.read_headered_ratings(spark, f"{run}/headered"))

    timed("headered_write_read", headered_round_trip)
    for name in (
        "in_blocks_item", "out_blocks_item", "block_stats", "ratings_profile", "comm_volume",
        "half_step_item", "half_step_blocks", "missing_vectors", "predict_pairs",
        "stream_latest_ratings", "stream_rating_counts", "stream_refit_mse",
    ):
        timed(name, lambda: run_all(q.queries()[name](spark, SF_DIR)))

    def builtin():
        from pyspark.ml.recommendation import ALS

        ALS(rank=5, maxIter=7, regParam=0.05, userCol="user_id", itemCol="item_id", ratingCol="rating").fit(ratings)

    timed("builtin_als_fit", builtin)
    timed("builtin_als_fit_warm", builtin)
    print(
        json.dumps(
            {
                "metric": "als_fit_rank5_iter7_warm",
                "value": seconds["als_fit_warm"],
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "facts": facts,
            }
        )
    )


if __name__ == "__main__":
    main()
