"""The registered queries: every operator over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import workdir
from ridgeline.functions.columns import features_to_columns, rounded
from ridgeline.functions.linalg import solve_factors
from ridgeline.operators import blocks, compare, gate, gradient, predict, quality
from ridgeline.operators.als import ALSFactorizer, ALSModel
from ridgeline.operators.evaluate import in_passes, vector_passes
from ridgeline.operators.holdout import Stop, split_cells
from ridgeline.operators.init import init_user_factors
from ridgeline.operators.layout import block_partitions, half_step, normal_equations, shuffle_cleanup
from ridgeline.plans.derive import event_ratings, order_ratings, purchases, table
from ridgeline.plans.oracle import HELD_OUT_SHARE, ITERATIONS, MOST_ITERATIONS, REG, STOP_GAIN
from ridgeline.schemas import FACTORS
from ridgeline.sources import bucketed, dense, headered
from ridgeline.streaming import counts, foldin, lists, profile, source, upsert
from ridgeline.streaming import headered as headered_text

NUM_BLOCKS = 8
RANK = 2


# --- helpers -----------------------------------------------------------------


def _fit(ratings: DataFrame, rank: int = RANK, iterations: int = ITERATIONS, **options) -> ALSModel:
    fit_options = {k: options.pop(k) for k in ("trace", "metrics") if k in options}
    return ALSFactorizer(rank=rank, reg=REG, max_iter=iterations, **options).fit(ratings, **fit_options)


def _flat(factors: DataFrame, rank: int = RANK) -> DataFrame:
    flat = factors.select("id", *features_to_columns("features", rank, "f"))
    return flat.select("id", *[rounded(f"f{q}").alias(f"f{q}") for q in range(rank)])


def _both_sides(model: ALSModel) -> DataFrame:
    sides = [("user", model.user_factors), ("item", model.item_factors)]
    user, item = [_flat(f).select(F.lit(s).alias("side"), "*") for s, f in sides]
    return user.unionByName(item)


def _rounded_errors(summary: DataFrame) -> DataFrame:
    return summary.select(
        F.col("n").cast("bigint").alias("n"), rounded("mse").alias("mse"), rounded("rmse").alias("rmse")
    )


def _per_user(cells: DataFrame) -> DataFrame:
    return cells.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("cells"),
        rounded(F.sum("prediction"), 4).alias("total"),
        rounded(F.min("prediction")).alias("lowest"),
        rounded(F.max("prediction")).alias("highest"),
    )


def _pairs(spark: SparkSession, sf_dir: str, item: str) -> DataFrame:
    """Distinct (buyer, id taken from another column of the line item)."""
    return (
        purchases(spark, sf_dir)
        .select(F.col("o_custkey").cast("int").alias("user_id"), F.col(item).cast("int").alias("item_id"))
        .distinct()
    )


# --- sources and sinks -------------------------------------------------------


def headered_roundtrip(spark, sf_dir):
    path = workdir.new_run_dir(spark, "headered")
    headered.write_headered_ratings(order_ratings(spark, sf_dir, dated=True), path)
    back = headered.read_headered_ratings(spark, path)
    return back.select("user_id", "item_id", "rating", F.col("rated_on").cast("string").alias("rated_on"))


def rejects_summary(spark, sf_dir):
    """Line items as rating lines, with defects wherever certain attributes meet."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    bought = purchases(spark, sf_dir).join(part, F.col("p_partkey") == F.col("l_partkey"))
    odd = (F.col("o_orderpriority") == "5-LOW") & (F.col("l_returnflag") == "A")
    number = F.col("l_linenumber")
    user = F.col("o_custkey").cast("string")
    day = F.col("o_orderdate").cast("date").cast("string")
    rating = (F.col("l_quantity").cast("int") % 5 + 1).cast("string")
    line = (
        F.when(odd & (number == 1), F.concat_ws(",", user, F.lit("n/a"), day))
        .when(odd & (number == 2), user)
        .when(odd & (number == 3), F.concat_ws(",", (-F.col("o_custkey") - 1).cast("string"), rating, day))
        .when(odd & (number == 4), F.lit(""))
        .otherwise(F.concat_ws(",", user, rating, day))
    )
    bad_header = F.col("p_size") == 50
    # Items with an unusable header sort apart, so they share no item id with others.
    lines = bought.select(
        F.when(bad_header, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey")).alias("item_id"),
        F.col("l_orderkey").alias("order_key"), line.alias("line"),
    )
    header = F.when(F.col("item_id") < 0, F.concat(F.lit("item "), F.col("item_id").cast("string")))
    path = workdir.new_run_dir(spark, "defects")
    headered.write_headered_lines(lines, path, header=header.otherwise(F.col("item_id").cast("string")))
    good, rejects = quality.split_rejects(headered.scan_headered_lines(spark, path))
    counted = rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    accepted = good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("accepted").alias("reason"), "n")
    return counted.unionByName(accepted)


def dense_file_roundtrip(spark, sf_dir):
    ratings = order_ratings(spark, sf_dir)
    model = _fit(ratings)
    path = dense.write_dense_predictions(model, workdir.new_run_dir(spark, "dense"))
    ids = lambda f, name: f.select(F.col("id").alias(name))
    return _per_user(
        dense.read_dense_predictions(
            spark, path, ids(model.user_factors, "user_id"), ids(model.item_factors, "item_id")
        )
    )


def dense_file_mse(spark, sf_dir):
    ratings = order_ratings(spark, sf_dir)
    path = dense.write_dense_predictions(_fit(ratings), workdir.new_run_dir(spark, "dense"))
    return _rounded_errors(dense.score_dense_predictions(spark, path, ratings))


def factors_save_load(spark, sf_dir):
    path = workdir.new_run_dir(spark, "model")
    _fit(order_ratings(spark, sf_dir)).save(path)
    return _both_sides(ALSModel.load(spark, path))


# --- blocks and aggregates ---------------------------------------------------


def block_assignment(spark, sf_dir):
    rows = blocks.with_block(order_ratings(spark, sf_dir), "user_id", NUM_BLOCKS, "user_block")
    rows = blocks.with_block(rows, "item_id", NUM_BLOCKS, "item_block")
    return rows.select("user_id", "item_id", "user_block", "item_block")


def rekey_user(spark, sf_dir):
    return blocks.rekey(order_ratings(spark, sf_dir), "user")


def _in_blocks(side, **options):
    def run(spark, sf_dir):
        lists = blocks.in_blocks(order_ratings(spark, sf_dir), side, **options)
        return lists.select("id", F.explode("entries").alias("e")).select("id", "e.other_id", "e.rating")

    return run


def _out_blocks(side):
    def run(spark, sf_dir):
        lists = blocks.out_blocks(order_ratings(spark, sf_dir), side, NUM_BLOCKS)
        return lists.select("id", F.explode("blocks").alias("block"))

    return run


def dependents_by_block(spark, sf_dir):
    lists = blocks.in_blocks(order_ratings(spark, sf_dir), "item")
    found = blocks.dependents_in_block(lists, NUM_BLOCKS)
    total = F.aggregate("dependent_ids", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return found.groupBy("id", "block").agg(
        F.sum(F.size("dependent_ids")).alias("n"), F.sum(total).alias("id_sum")
    )


def block_stats(spark, sf_dir):
    ratings = order_ratings(spark, sf_dir)
    user, item = [
        blocks.block_stats(ratings, side, NUM_BLOCKS).select(F.lit(side).alias("side"), "*")
        for side in ("user", "item")
    ]
    return user.unionByName(item)


def ratings_profile(spark, sf_dir):
    found = quality.profile(order_ratings(spark, sf_dir))
    return found.withColumn("sparsity", rounded("sparsity"))


def comm_volume(spark, sf_dir):
    return blocks.comm_volume(order_ratings(spark, sf_dir), NUM_BLOCKS)


def init_factors(spark, sf_dir):
    return _flat(init_user_factors(order_ratings(spark, sf_dir), 3), 3)


# --- ALS ---------------------------------------------------------------------


def _item_systems(spark, sf_dir):
    ratings = order_ratings(spark, sf_dir)
    return normal_equations(ratings, init_user_factors(ratings, RANK), "item", RANK)


def normal_equations_item(spark, sf_dir):
    sums = ["a0_0", "a0_1", "a1_1", "v0", "v1"]
    return _item_systems(spark, sf_dir).select("id", "n", *[rounded(c).alias(c) for c in sums])


def normal_equations_item_batches(spark, sf_dir):
    """The packed systems of the batch kernels, laid out like the summed ones."""
    ratings = order_ratings(spark, sf_dir)
    packed = normal_equations(ratings, init_user_factors(ratings, RANK), "item", RANK, kernel="batches")
    cells = {"a0_0": F.col("a")[0], "a0_1": F.col("a")[1], "a1_1": F.col("a")[3], "v0": F.col("v")[0], "v1": F.col("v")[1]}
    return packed.select("id", "n", *[F.round(c, 6).alias(name) for name, c in cells.items()])


def solve_item(spark, sf_dir):
    return _flat(solve_factors(_item_systems(spark, sf_dir), RANK, REG))


def _item_half_step(**options):
    def run(spark, sf_dir):
        ratings = order_ratings(spark, sf_dir)
        users = init_user_factors(ratings, RANK)
        return _flat(half_step(ratings, users, "item", RANK, REG, **options))

    return run


def _item_conjugate(**options):
    def query(spark, sf_dir):
        ratings = order_ratings(spark, sf_dir)
        users = init_user_factors(ratings, RANK)
        return _flat(gradient.half_step(ratings, users, "item", RANK, REG, **options))

    return query


def als_conjugate_factors(spark, sf_dir):
    return _both_sides(_fit(order_ratings(spark, sf_dir), solver="gradient"))


def half_step_user(spark, sf_dir):
    ratings = order_ratings(spark, sf_dir)
    items = half_step(ratings, init_user_factors(ratings, RANK), "item", RANK, REG)
    return _flat(half_step(ratings, items, "user", RANK, REG))


def als_user_factors(spark, sf_dir):
    return _flat(_fit(order_ratings(spark, sf_dir)).user_factors)


def als_item_factors(spark, sf_dir):
    return _flat(_fit(order_ratings(spark, sf_dir)).item_factors)


def als_blocks_factors(spark, sf_dir):
    return _both_sides(_fit(order_ratings(spark, sf_dir), strategy="blocks", num_blocks=NUM_BLOCKS))


def als_bucketed_factors(spark, sf_dir):
    """Stored once; fitted by another session that opens the folder."""
    path = workdir.new_run_dir(spark, "stored-ratings")
    bucketed.store_ratings(order_ratings(spark, sf_dir), path, NUM_BLOCKS)
    stored = bucketed.open_ratings(spark.newSession(), path)
    model = ALSFactorizer(rank=RANK, reg=REG, max_iter=ITERATIONS).fit_stored(stored)
    stored.drop()
    sides = [spark.read.parquet(f"{model.path}/{side}-factors-{ITERATIONS}") for side in ("user", "item")]
    return _both_sides(ALSModel(*sides, RANK, REG, model.users, model.items))


def als_batches_factors(spark, sf_dir):
    return _both_sides(_fit(order_ratings(spark, sf_dir), kernel="batches"))


def als_rank20_gradient(spark, sf_dir):
    """The users' normal equations at rank 20, left minus right per feature: zero at a solution."""
    rank = 20
    path = workdir.new_run_dir(spark, "gradients")
    with shuffle_cleanup(spark):
        ratings = workdir.write_table(order_ratings(spark, sf_dir), f"{path}/ratings")  # read by the fit and here
    model = _fit(ratings, rank=rank)
    users = model.user_factors.select(F.col("id").alias("user_id"), F.col("features").alias("u"))
    items = model.item_factors.select(F.col("id").alias("item_id"), F.col("features").alias("m"))
    guess = F.aggregate(F.zip_with("u", "m", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    pulls = [
        (F.sum(F.col("e") * F.col("m")[q]) + F.count("*") * REG * F.first(F.col("u")[q])).alias(f"pull{q}") for q in range(rank)
    ]
    gradients = F.array(*[F.round(f"pull{q}", 6) + 0.0 for q in range(rank)])

    def of(ratings, users):
        # Users last: the join leaves each user's rows together, and they are summed before a row per feature is made.
        both = ratings.join(items, "item_id").join(users, "user_id")
        rows = both.select("user_id", "u", "m", (guess - F.col("rating")).alias("e"))
        return rows.groupBy("user_id").agg(*pulls).select("user_id", F.posexplode(gradients).alias("feature", "gradient"))

    passes = vector_passes(ratings.count(), rank)
    parts = [of(*both) for both in zip(in_passes(ratings, "user_id", passes), in_passes(users, "user_id", passes))]
    if passes == 1:
        return parts[0]
    with shuffle_cleanup(spark):
        for part in parts:
            part.write.mode("append").parquet(f"{path}/found")
    return spark.read.schema(parts[0].schema).parquet(f"{path}/found")


def fit_metrics_checked(spark, sf_dir):
    timed = (F.col("seconds") > 0).cast("int").alias("timed")
    return fit_metrics(spark, sf_dir).select("iteration", "side", "rows", timed)


def compare_builtin_checked(spark, sf_dir):
    """Both engines on the same ratings; RMSE within 5 percent of each other."""
    found = compare_builtin(spark, sf_dir)
    bounds = found.agg(F.min("rmse").alias("low"), F.max("rmse").alias("high"))
    close = (F.col("high") <= 1.05 * F.col("low")).cast("int").alias("close")
    return found.select("engine", "n").crossJoin(F.broadcast(bounds.select(close)))  # one row


def factor_collection(spark, sf_dir):
    """Two runs as two versions: the longer run is the last word on every user."""
    ratings = order_ratings(spark, sf_dir)
    runs = [_fit(ratings, iterations=i).user_factors.withColumn("version", F.lit(i)) for i in (1, ITERATIONS)]
    return _flat(gate.latest_factors(runs[0].unionByName(runs[1])))


def convergence_trace(spark, sf_dir):
    trace = _fit(order_ratings(spark, sf_dir), trace=True).trace
    return trace.select(
        "iteration", rounded("mse").alias("mse"), rounded("rmse").alias("rmse"),
        rounded("objective", 4).alias("objective"),
    )


def convergence_stop(spark, sf_dir):
    """Errors on kept and held-out cells until the held-out error has ceased to fall."""
    kept, held_out = split_cells(order_ratings(spark, sf_dir), HELD_OUT_SHARE)
    model = ALSFactorizer(rank=RANK, reg=REG, max_iter=MOST_ITERATIONS).fit(kept, stop=Stop(held_out, STOP_GAIN))
    errors = [rounded(c).alias(c) for c in ("train_mse", "held_out_mse")]
    return model.held_out.select("iteration", *errors, F.col("improved").cast("int").alias("improved"))


def objective(spark, sf_dir):
    ratings = order_ratings(spark, sf_dir)
    return _fit(ratings).objective(ratings).select(
        rounded("mse").alias("mse"), rounded("rmse").alias("rmse"),
        rounded("objective", 4).alias("objective"),
    )


def missing_vectors(spark, sf_dir):
    """Only the users whose mean rating is at most 3 have sent their vector."""
    ratings = order_ratings(spark, sf_dir)
    arrived = init_user_factors(ratings, RANK).filter(F.col("features")[0] <= 3)
    return gate.missing_vectors(ratings, arrived, "item")


def compare_builtin(spark, sf_dir):
    return compare.compare_builtin(order_ratings(spark, sf_dir))


def fit_metrics(spark, sf_dir):
    return _fit(order_ratings(spark, sf_dir), metrics=True).metrics


def als_rank20_mse(spark, sf_dir):
    """The wide-rank path: systems built from Arrow batches."""
    with shuffle_cleanup(spark):
        ratings = workdir.write_table(order_ratings(spark, sf_dir), workdir.new_run_dir(spark, "ratings"))  # read twice
    return _rounded_errors(_fit(ratings, rank=20).evaluate(ratings))


# --- prediction --------------------------------------------------------------


def predict_dense(spark, sf_dir):
    return _per_user(_fit(order_ratings(spark, sf_dir)).predict_all())


def predict_pairs(spark, sf_dir):
    model = _fit(order_ratings(spark, sf_dir))
    found = model.predict_pairs(_pairs(spark, sf_dir, "l_orderkey"))
    cold = F.isnan("prediction")
    return found.select(
        "user_id", "item_id", cold.cast("int").alias("cold"),
        F.when(cold, F.lit(0.0)).otherwise(rounded("prediction")).alias("prediction"),
    )


#: Paths of large tables at any size: nothing is broadcast, small ids count as hot.
SPREAD = dict(broadcast_limit=0, hot_limit=20)


def predict_pairs_spread(spark, sf_dir):
    model = _fit(order_ratings(spark, sf_dir))
    found = model.predict_pairs(_pairs(spark, sf_dir, "l_orderkey"), **SPREAD)
    cold = F.isnan("prediction")
    return found.select(
        "user_id", "item_id", cold.cast("int").alias("cold"),
        F.when(cold, F.lit(0.0)).otherwise(rounded("prediction")).alias("prediction"),
    )


def evaluate_spread(spark, sf_dir):
    ratings = order_ratings(spark, sf_dir)
    return _rounded_errors(_fit(ratings).evaluate(ratings, **SPREAD))


def missing_vectors_spread(spark, sf_dir):
    ratings = order_ratings(spark, sf_dir)
    arrived = init_user_factors(ratings, RANK).filter(F.col("features")[0] <= 3)
    return gate.missing_vectors(ratings, arrived, "item", **SPREAD)


def predict_dense_grid(spark, sf_dir):
    return _per_user(_fit(order_ratings(spark, sf_dir)).predict_all(broadcast_limit=0, user_block=256, item_block=512))


def recommend_grid(spark, sf_dir):
    model = _fit(order_ratings(spark, sf_dir))
    best = model.recommend(5, broadcast_limit=0, user_block=256, item_block=512)
    return best.select("user_id", "item_id", "rank", rounded("prediction").alias("prediction"))


def unrated_counts(spark, sf_dir):
    return predict.unrated_counts(order_ratings(spark, sf_dir))


def unrated_candidates(spark, sf_dir):
    return predict.unrated_pairs(_pairs(spark, sf_dir, "l_suppkey"), order_ratings(spark, sf_dir))


def rated_candidates(spark, sf_dir):
    return predict.rated_pairs(_pairs(spark, sf_dir, "l_suppkey"), order_ratings(spark, sf_dir))


def recommend_top5(spark, sf_dir):
    best = _fit(order_ratings(spark, sf_dir)).recommend(5)
    return best.select("user_id", "item_id", "rank", rounded("prediction").alias("prediction"))


def recommend_pruned(spark, sf_dir):
    best = _fit(order_ratings(spark, sf_dir)).recommend(5, prune=True)
    return best.select("user_id", "item_id", "rank", rounded("prediction").alias("prediction"))


def evaluate_mse(spark, sf_dir):
    ratings = order_ratings(spark, sf_dir)
    return _rounded_errors(_fit(ratings).evaluate(ratings))


# --- streaming ---------------------------------------------------------------


def _event_stream(spark, sf_dir, files: int = 3):
    """The events table as several files, read one per micro-batch."""
    events = table(spark, sf_dir, "events")
    path = workdir.new_run_dir(spark, "event-files")
    events.repartition(files).write.parquet(path)
    stream = source.read_ratings_stream(spark, path, events.schema, max_files_per_trigger=1)
    return event_ratings(stream)


def _landed(spark, sf_dir, every: int):
    path = workdir.new_run_dir(spark, "ratings-log")
    query = upsert.refit_stream(
        _event_stream(spark, sf_dir), f"{path}/table", f"{path}/checkpoint", every,
        ALSFactorizer(rank=RANK, reg=REG, max_iter=ITERATIONS),
    )
    query.awaitTermination()
    return f"{path}/table"


def stream_latest_ratings(spark, sf_dir):
    path = workdir.new_run_dir(spark, "ratings-log")
    upsert.upsert_stream(_event_stream(spark, sf_dir), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return upsert.current_ratings(spark, f"{path}/table").select("user_id", "item_id", "rating")


def stream_rating_counts(spark, sf_dir):
    path = workdir.new_run_dir(spark, "counts")
    running = counts.rating_counts_stream(_event_stream(spark, sf_dir), "item")
    counts.write_counts_stream(running, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return counts.current_counts(spark, f"{path}/table")


def stream_profile(spark, sf_dir):
    """Sketched profile per rating and (rating 0) in all, after each estimate a flag: within 3 percent of exact."""
    path = workdir.new_run_dir(spark, "profile")
    stream = _event_stream(spark, sf_dir, files=5)
    profile.profile_stream(stream, f"{path}/table", f"{path}/checkpoint", ("rating",), compact_every=2).awaitTermination()
    found = profile.current_profile(spark, f"{path}/table", ("rating",)).unionByName(
        profile.current_profile(spark, f"{path}/table").withColumn("rating", F.lit(0).cast("smallint"))
    )
    events = event_ratings(table(spark, sf_dir, "events"))
    each = F.explode(F.array(F.col("rating"), F.lit(0).cast("smallint")))
    exact = events.select("user_id", "item_id", each.alias("rating")).groupBy("rating").agg(
        *[F.countDistinct(*columns).alias(f"exact_{name}") for name, columns in profile.DISTINCT.items()]
    )
    close = [
        (F.abs(F.col(name) - F.col(f"exact_{name}")) <= 0.03 * F.col(f"exact_{name}")).cast("int").alias(f"{name}_close")
        for name in profile.DISTINCT
    ]
    return found.join(exact, "rating").select("rating", "ratings", rounded("mean").alias("mean"), *close)


def stream_rating_lists(spark, sf_dir):
    """State of a stream that takes in two files, ends, and goes on with two more from its checkpoint."""
    path = workdir.new_run_dir(spark, "rating-lists")
    events = table(spark, sf_dir, "events")
    late = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 1
    for part in (events.where(~late), events.where(late)):
        part.repartition(2).write.mode("append").parquet(f"{path}/events")
        stream = source.read_ratings_stream(
            lists.stateful_session(spark), f"{path}/events", events.schema, max_files_per_trigger=1
        )
        changes = lists.rating_lists_stream(event_ratings(stream), "item")
        lists.write_lists_stream(changes, f"{path}/checkpoint").awaitTermination()
    return lists.read_rating_lists(spark, f"{path}/checkpoint").select("id", "other_id", "rating")


def stream_headered(spark, sf_dir):
    """R1 as one text that is cut inside items, arriving in three steps; the stream starts anew for each."""
    path = workdir.new_run_dir(spark, "headered-stream")
    ratings = workdir.write_table(order_ratings(spark, sf_dir, dated=True), f"{path}/ratings")  # read often below
    line = F.concat_ws(",", F.col("user_id").cast("string"), F.col("rating").cast("string"), F.col("rated_on").cast("string"))
    lines = ratings.select("item_id", "user_id", line.alias("line"))
    heads = ratings.select("item_id").distinct().select(
        "item_id", F.lit(-1).alias("user_id"), F.concat(F.col("item_id").cast("string"), F.lit(":")).alias("line")
    )
    files = block_partitions(2, -(-ratings.count() // 3))  # of a step
    cut = lines.unionByName(heads).repartitionByRange(3 * files, "item_id", "user_id")
    text = workdir.write_table(cut.withColumn("cut", F.spark_partition_id()), f"{path}/lines")
    for step in range(3):
        here = text.where((F.col("cut") >= files * step) & (F.col("cut") < files * (step + 1)))
        ordered = here.repartitionById(files, F.col("cut") - files * step).sortWithinPartitions("item_id", "user_id")
        ordered.select("line").write.text(f"{path}/text/step={step}")
        headered_text.headered_stream(spark, f"{path}/text/*", f"{path}/table", f"{path}/checkpoint").awaitTermination()
    landed = headered_text.landed_ratings(spark, f"{path}/table")
    return landed.select("user_id", "item_id", "rating", F.col("rated_on").cast("string").alias("rated_on"))


def als_resumed_factors(spark, sf_dir):
    """A fit that breaks off after one iteration, and another that goes on from what it left."""
    ratings = order_ratings(spark, sf_dir)
    path = workdir.new_run_dir(spark, "als-resumed")
    fit = ALSFactorizer(rank=RANK, reg=REG, max_iter=ITERATIONS)

    def lost(iteration):
        raise InterruptedError(f"driver lost after iteration {iteration}")

    try:
        fit.fit(ratings, resume=path, on_iteration=lost)
    except InterruptedError:
        pass
    return _both_sides(fit.fit(ratings, resume=path))


def fold_in_users(spark, sf_dir):
    """Customers of three nations turn their ratings round; only their vectors are solved again."""
    ratings = order_ratings(spark, sf_dir)
    path = workdir.new_run_dir(spark, "folds")
    log = f"{path}/table"
    landed = ratings.select("user_id", "item_id", "rating", F.lit(0).cast("timestamp").alias("rated_at"), F.lit(0).cast("bigint").alias("seq"))
    upsert.write_delta(landed, 0, log)
    base = upsert.compact(spark, log, 0)
    model = ALSFactorizer(rank=RANK, reg=REG, max_iter=ITERATIONS).fit(base)
    model.save(f"{log}/factors/version=0")
    model.release()
    movers = table(spark, sf_dir, "customer").where("c_nationkey < 3").select(F.col("c_custkey").cast("int").alias("user_id"))
    turned = landed.join(movers, "user_id", "left_semi").withColumns(
        {"rating": (F.lit(6) - F.col("rating")).cast("smallint"), "seq": F.lit(1).cast("bigint")}
    )
    upsert.write_delta(turned, 1, log)
    foldin.fold_batch(spark, log, 1)
    solved = spark.read.schema(FACTORS).parquet(foldin.fold_path(log, "user", 1)).select("id", F.lit(1).alias("solved"))
    factors = _flat(foldin.current_model(spark, log).user_factors)
    return factors.join(solved, "id", "left").select("id", F.coalesce("solved", F.lit(0)).alias("solved"), "f0", "f1")


def stream_refit_mse(spark, sf_dir):
    landed = _landed(spark, sf_dir, every=3)
    model = upsert.latest_model(spark, landed)
    return _rounded_errors(model.evaluate(upsert.current_ratings(spark, landed)))


def stream_refit_tail_mse(spark, sf_dir):
    """Four micro-batches and a refit every third: the fourth is fitted when the stream has ended."""
    path = workdir.new_run_dir(spark, "stream")
    fit = ALSFactorizer(rank=RANK, reg=REG, max_iter=ITERATIONS)
    stream = _event_stream(spark, sf_dir, files=4)
    upsert.refit_stream(stream, f"{path}/table", f"{path}/checkpoint", 3, fit).awaitTermination()
    upsert.refit_pending(spark, f"{path}/table", fit)
    model = upsert.latest_model(spark, f"{path}/table")
    return _rounded_errors(model.evaluate(upsert.current_ratings(spark, f"{path}/table")))


def queries():
    return {
        "headered_roundtrip": headered_roundtrip,
        "rejects_summary": rejects_summary,
        "block_assignment": block_assignment,
        "rekey_user": rekey_user,
        "dependents_by_block": dependents_by_block,
        "in_blocks_item": _in_blocks("item"),
        "in_blocks_user": _in_blocks("user"),
        "out_blocks_item": _out_blocks("item"),
        "out_blocks_user": _out_blocks("user"),
        "block_stats": block_stats,
        "ratings_profile": ratings_profile,
        "comm_volume": comm_volume,
        "init_factors": init_factors,
        "normal_equations_item": normal_equations_item,
        "normal_equations_item_batches": normal_equations_item_batches,
        "solve_item": solve_item,
        "half_step_item": _item_half_step(),
        "half_step_shuffle": _item_half_step(strategy="shuffle"),
        "half_step_blocks": _item_half_step(strategy="blocks", num_blocks=NUM_BLOCKS),
        "half_step_split_items": _item_half_step(strategy="blocks", num_blocks=NUM_BLOCKS, hot_limit=20),
        "half_step_item_batches": _item_half_step(kernel="batches", strategy="broadcast"),
        "half_step_shuffle_batches": _item_half_step(kernel="batches", strategy="shuffle"),
        "half_step_blocks_batches": _item_half_step(kernel="batches", strategy="blocks", num_blocks=NUM_BLOCKS, hot_limit=20),
        "half_step_conjugate": _item_conjugate(),
        "half_step_conjugate_blocks": _item_conjugate(strategy="blocks", num_blocks=NUM_BLOCKS, hot_limit=20),
        "half_step_user": half_step_user,
        "als_user_factors": als_user_factors,
        "als_item_factors": als_item_factors,
        "als_blocks_factors": als_blocks_factors,
        "als_bucketed_factors": als_bucketed_factors,
        "als_batches_factors": als_batches_factors,
        "als_conjugate_factors": als_conjugate_factors,
        "als_rank20_mse": als_rank20_mse,
        "als_rank20_gradient": als_rank20_gradient,
        "fit_metrics_checked": fit_metrics_checked,
        "compare_builtin_checked": compare_builtin_checked,
        "predict_pairs_spread": predict_pairs_spread,
        "evaluate_spread": evaluate_spread,
        "missing_vectors_spread": missing_vectors_spread,
        "predict_dense_grid": predict_dense_grid,
        "recommend_grid": recommend_grid,
        "in_blocks_split": _in_blocks("item", max_entries=10),
        "factor_collection": factor_collection,
        "convergence_trace": convergence_trace,
        "convergence_stop": convergence_stop,
        "objective": objective,
        "missing_vectors": missing_vectors,
        "compare_builtin": compare_builtin,
        "fit_metrics": fit_metrics,
        "predict_dense": predict_dense,
        "predict_pairs": predict_pairs,
        "unrated_counts": unrated_counts,
        "unrated_candidates": unrated_candidates,
        "rated_candidates": rated_candidates,
        "recommend_top5": recommend_top5,
        "evaluate_mse": evaluate_mse,
        "dense_file_roundtrip": dense_file_roundtrip,
        "dense_file_mse": dense_file_mse,
        "factors_save_load": factors_save_load,
        "stream_latest_ratings": stream_latest_ratings,
        "stream_rating_counts": stream_rating_counts,
        "stream_profile": stream_profile,
        "stream_rating_lists": stream_rating_lists,
        "recommend_pruned": recommend_pruned,
        "stream_headered": stream_headered,
        "als_resumed_factors": als_resumed_factors,
        "fold_in_users": fold_in_users,
        "stream_refit_mse": stream_refit_mse,
        "stream_refit_tail_mse": stream_refit_tail_mse,
    }
