"""Physical plans and working folders."""

import re

import pytest

from ridgeline import workdir
from ridgeline.operators.evaluate import evaluate
from ridgeline.operators.init import init_user_factors
from ridgeline.operators.layout import block_partitioning, build_layout, default_partitions
from ridgeline.plans.derive import order_ratings

from conftest import SF_DIR


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above_cache(plan):
    """The plan without what is inside cached relations."""
    lines, skip = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if skip is not None and depth > skip:
            continue
        skip = depth if "InMemoryRelation" in line else None
        lines.append(line)
    return "\n".join(lines)


@pytest.mark.parametrize("strategy,shuffles", [("broadcast", 0), ("blocks", 1), ("shuffle", 2)])
def test_a_half_step_moves_no_ratings(spark, strategy, shuffles):
    """Only vectors (and, for ``shuffle``, partial sums) cross an exchange."""
    ratings = order_ratings(spark, SF_DIR)
    users = workdir.write_table(init_user_factors(ratings, 2), workdir.new_run_dir(spark, "t"))
    layout = build_layout(ratings, "item", 2, strategy, num_blocks=4).persist()
    with block_partitioning(spark):
        plan = above_cache(plan_of(layout.systems(users, 2)))
    layout.unpersist()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan and "MapInArrow" not in plan
    exchanges = re.findall(r"Exchange (?:hashpartitioning|shufflepartitionidpassthrough)\(([^)]*)\)", plan)
    assert len(exchanges) == shuffles, plan


def test_block_setting_is_put_back(spark):
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError):
        with block_partitioning(spark):
            raise RuntimeError
    assert spark.conf.get(key) == before


def test_scans_read_only_what_is_needed(spark):
    plan = plan_of(order_ratings(spark, SF_DIR))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    columns = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert columns == {"o_orderkey", "o_custkey", "l_orderkey", "l_partkey", "l_quantity"}


def test_big_vector_tables_are_not_broadcast(spark, skewed):
    users = init_user_factors(skewed, 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(evaluate(users, users, skewed, 2, broadcast_limit=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Cartesian" not in plan


def test_partitions_follow_the_data(spark):
    cores = spark.sparkContext.defaultParallelism
    assert default_partitions(spark, 0) == 1
    assert default_partitions(spark, 10_000_000) == max(cores, 5)
    assert default_partitions(spark, 10**12) == 500_000


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert workdir.shared_dir(spark) == configured.rstrip("/")
    assert workdir.new_run_dir(spark, "a") != workdir.new_run_dir(spark, "a")
