"""SQL that computes the registered queries independently of Spark.

With two features a ridge system has a closed solution, so a whole ALS run is a
chain of grouped sums.
"""

from __future__ import annotations

REG = 0.05
ITERATIONS = 2
# The fit that stops by itself.
HELD_OUT_SHARE = 0.2
STOP_GAIN = 0.02
MOST_ITERATIONS = 6

R1 = """r1 AS (
  SELECT CAST(o_custkey AS INTEGER) AS user_id, CAST(l_partkey AS INTEGER) AS item_id,
         CAST(MAX(CAST(l_quantity AS INTEGER)) % 5 + 1 AS SMALLINT) AS rating,
         CAST(MAX(o_orderdate) AS DATE) AS rated_on
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"""

R2_EVENTS = r"""ev AS (
  SELECT CAST(user_id AS INTEGER) AS user_id,
         CAST(regexp_extract(props, '"k": (\d+)', 1) AS INTEGER) AS item_id,
         CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2
              WHEN 'signup' THEN 4 WHEN 'purchase' THEN 5 END AS SMALLINT) AS rating,
         ts, event_id
  FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase'))"""

R2 = R2_EVENTS + """, r1 AS (
  SELECT user_id, item_id, CAST(arg_max(rating, (ts, event_id)) AS SMALLINT) AS rating
  FROM ev GROUP BY 1, 2)"""


def start(rank: int = 2) -> str:
    rest = "".join(
        f", ((CAST(user_id AS BIGINT) * 7919 + {q} * 104729) % 10007 + 1) / CAST(10008 AS DOUBLE) AS f{q}"
        for q in range(1, rank)
    )
    return f"u0 AS (SELECT user_id AS id, CAST(AVG(rating) AS DOUBLE) AS f0{rest} FROM r1 GROUP BY user_id)"


def systems(name: str, side: str, factors: str, ratings: str = "r1") -> str:
    own, other = ("item_id", "user_id") if side == "item" else ("user_id", "item_id")
    return f"""{name} AS (
  SELECT {own} AS id, COUNT(*) AS n, SUM(f0 * f0) AS a0_0, SUM(f0 * f1) AS a0_1,
         SUM(f1 * f1) AS a1_1, SUM(f0 * rating) AS v0, SUM(f1 * rating) AS v1
  FROM {ratings} JOIN {factors} f ON f.id = {other} GROUP BY {own})"""


def solved(name: str, from_systems: str) -> str:
    a, d = f"(a0_0 + {REG} * n)", f"(a1_1 + {REG} * n)"
    det = f"({a} * {d} - a0_1 * a0_1)"
    return f"""{name} AS (
  SELECT id, (v0 * {d} - v1 * a0_1) / {det} AS f0, (v1 * {a} - v0 * a0_1) / {det} AS f1
  FROM {from_systems})"""


def half(name: str, side: str, factors: str) -> list[str]:
    return [systems(f"s_{name}", side, factors), solved(name, f"s_{name}")]


def als(iterations: int = ITERATIONS, ratings: str = R1) -> list[str]:
    ctes = [ratings, start()]
    for i in range(1, iterations + 1):
        ctes += half(f"m{i}", "item", f"u{i - 1}")
        ctes += half(f"u{i}", "user", f"m{i}")
    return ctes


def query(ctes: list[str], body: str) -> str:
    return f"WITH {', '.join(ctes)}\n{body}"


def r6(expression: str, name: str, digits: int = 6) -> str:
    return f"ROUND({expression}, {digits}) + 0.0 AS {name}"


FACTORS = f"id, {r6('f0', 'f0')}, {r6('f1', 'f1')}"
PREDICTION = "(u.f0 * m.f0 + u.f1 * m.f1)"


def errors(i: int) -> str:
    return f"""e{i} AS (
  SELECT r.user_id, r.item_id, r.rating - {PREDICTION} AS err,
         u.f0 * u.f0 + u.f1 * u.f1 + m.f0 * m.f0 + m.f1 * m.f1 AS norms
  FROM r1 r JOIN u{i} u ON u.id = r.user_id JOIN m{i} m ON m.id = r.item_id)"""


def scores(i: int, lead: str = "") -> str:
    return f"""SELECT {lead}{r6('AVG(err * err)', 'mse')}, {r6('SQRT(AVG(err * err))', 'rmse')},
       {r6(f'SUM(err * err) + {REG} * SUM(norms)', 'objective', 4)} FROM e{i}"""


MSE = f"SELECT COUNT(*) AS n, {r6('AVG(err * err)', 'mse')}, {r6('SQRT(AVG(err * err))', 'rmse')} FROM e{ITERATIONS}"


def _exploded_in_block(own: str, other: str) -> str:
    return query([R1], f"SELECT {own} AS id, {other} AS other_id, rating FROM r1")


def _exploded_out_block(own: str, other: str, blocks: int) -> str:
    return query([R1], f"SELECT DISTINCT {own} AS id, CAST({other} % {blocks} AS INTEGER) AS block FROM r1")


def oracle_sql(blocks: int) -> dict[str, str]:
    fit = als()
    last = ITERATIONS
    dense = f"u{last} u CROSS JOIN m{last} m"
    per_user_dense = f"""SELECT u.id AS user_id, COUNT(*) AS cells,
       {r6(f'SUM({PREDICTION})', 'total', 4)}, {r6(f'MIN({PREDICTION})', 'lowest')},
       {r6(f'MAX({PREDICTION})', 'highest')} FROM {dense} GROUP BY u.id"""
    factor_rows = query(
        fit,
        f"SELECT 'user' AS side, {FACTORS} FROM u{last} UNION ALL SELECT 'item' AS side, {FACTORS} FROM m{last}",
    )
    item_half = query([R1, start(), *half("m1", "item", "u0")], f"SELECT {FACTORS} FROM m1")
    lines = """raw AS (
  SELECT CAST(o_custkey AS INTEGER) AS user_id, CAST(l_partkey AS INTEGER) AS item_id,
         CASE WHEN p_size = 50 THEN 'no_header'
              WHEN o_orderpriority = '5-LOW' AND l_returnflag = 'A' AND l_linenumber = 3 THEN 'negative_id' END AS unowned,
         CASE WHEN o_orderpriority = '5-LOW' AND l_returnflag = 'A' AND l_linenumber = 1 THEN 'bad_number'
              WHEN o_orderpriority = '5-LOW' AND l_returnflag = 'A' AND l_linenumber IN (2, 4) THEN 'missing_field' END AS unparsed
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
classified AS (SELECT user_id, item_id, COALESCE(unparsed, unowned) AS reason FROM raw)"""
    candidates = "c AS (SELECT DISTINCT CAST(o_custkey AS INTEGER) AS user_id, CAST(l_suppkey AS INTEGER) AS item_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
    trace = " UNION ALL ".join(
        scores(i, f"CAST({i} AS INTEGER) AS iteration, ") for i in range(1, last + 1)
    )
    known = {
        "headered_roundtrip": query(
            [R1], "SELECT user_id, item_id, rating, CAST(rated_on AS VARCHAR) AS rated_on FROM r1"
        ),
        "rejects_summary": f"""WITH {lines}
SELECT reason, CAST(COUNT(*) AS BIGINT) AS n FROM classified WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'bad_header', COUNT(DISTINCT item_id) FROM classified JOIN part ON p_partkey = item_id WHERE p_size = 50
UNION ALL SELECT 'duplicate', COUNT(*) - COUNT(DISTINCT (user_id, item_id)) FROM classified WHERE reason IS NULL
UNION ALL SELECT 'accepted', COUNT(DISTINCT (user_id, item_id)) FROM classified WHERE reason IS NULL""",
        "block_assignment": query(
            [R1],
            f"SELECT user_id, item_id, CAST(user_id % {blocks} AS INTEGER) AS user_block, CAST(item_id % {blocks} AS INTEGER) AS item_block FROM r1",
        ),
        "rekey_user": _exploded_in_block("user_id", "item_id"),
        "dependents_by_block": query(
            [R1],
            f"SELECT item_id AS id, CAST(user_id % {blocks} AS INTEGER) AS block, COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS id_sum FROM r1 GROUP BY 1, 2",
        ),
        "in_blocks_item": _exploded_in_block("item_id", "user_id"),
        "in_blocks_user": _exploded_in_block("user_id", "item_id"),
        "out_blocks_item": _exploded_out_block("item_id", "user_id", blocks),
        "out_blocks_user": _exploded_out_block("user_id", "item_id", blocks),
        "block_stats": query(
            [R1],
            " UNION ALL ".join(
                f"SELECT '{s}' AS side, CAST({s}_id % {blocks} AS INTEGER) AS block, COUNT(DISTINCT {s}_id) AS ids, COUNT(*) AS ratings FROM r1 GROUP BY 1, 2"
                for s in ("user", "item")
            ),
        ),
        "ratings_profile": query(
            [R1],
            "SELECT COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT item_id) AS items, COUNT(*) AS ratings, "
            + r6("1 - COUNT(*) / (CAST(COUNT(DISTINCT user_id) AS DOUBLE) * COUNT(DISTINCT item_id))", "sparsity")
            + " FROM r1",
        ),
        "comm_volume": query(
            [R1],
            " UNION ALL ".join(
                f"SELECT '{s}' AS side, COUNT(*) AS all_to_all, COUNT(DISTINCT ({s}_id, {o}_id % {blocks})) AS block_to_block FROM r1"
                for s, o in (("user", "item"), ("item", "user"))
            ),
        ),
        "init_factors": query([R1, start(3)], f"SELECT id, {r6('f0', 'f0')}, {r6('f1', 'f1')}, {r6('f2', 'f2')} FROM u0"),
        "normal_equations_item": query(
            [R1, start(), systems("s", "item", "u0")],
            "SELECT id, n, " + ", ".join(r6(c, c) for c in ("a0_0", "a0_1", "a1_1", "v0", "v1")) + " FROM s",
        ),
        "solve_item": item_half,
        "half_step_item": item_half,
        "half_step_shuffle": item_half,
        "half_step_blocks": item_half,
        "half_step_split_items": item_half,
        "half_step_user": query(
            [R1, start(), *half("m1", "item", "u0"), *half("u1", "user", "m1")], f"SELECT {FACTORS} FROM u1"
        ),
        "als_user_factors": query(fit, f"SELECT {FACTORS} FROM u{last}"),
        "als_item_factors": query(fit, f"SELECT {FACTORS} FROM m{last}"),
        "als_blocks_factors": factor_rows,
        "factor_collection": query(fit, f"SELECT {FACTORS} FROM u{last}"),
        "convergence_trace": query([*fit, *[errors(i) for i in range(1, last + 1)]], trace),
        "objective": query([*fit, errors(last)], scores(last)),
        "missing_vectors": query(
            [R1, start()],
            "SELECT item_id AS id, COUNT(*) AS expected, COUNT(u.id) AS received FROM r1 LEFT JOIN (SELECT id FROM u0 WHERE f0 <= 3) u ON u.id = user_id GROUP BY 1 HAVING COUNT(u.id) < COUNT(*)",
        ),
        "predict_dense": query(fit, per_user_dense),
        "predict_pairs": query(
            [*fit, "p AS (SELECT DISTINCT CAST(o_custkey AS INTEGER) AS user_id, CAST(l_orderkey AS INTEGER) AS item_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"],
            f"SELECT p.user_id, p.item_id, CAST(CASE WHEN m.id IS NULL OR u.id IS NULL THEN 1 ELSE 0 END AS INTEGER) AS cold, COALESCE(ROUND({PREDICTION}, 6), 0.0) + 0.0 AS prediction FROM p LEFT JOIN u{last} u ON u.id = p.user_id LEFT JOIN m{last} m ON m.id = p.item_id",
        ),
        "unrated_counts": query(
            [R1],
            "SELECT user_id, COUNT(*) AS rated, (SELECT COUNT(DISTINCT item_id) FROM r1) - COUNT(*) AS unrated FROM r1 GROUP BY 1",
        ),
        "unrated_candidates": query([R1, candidates], "SELECT c.user_id, c.item_id FROM c ANTI JOIN r1 USING (user_id, item_id)"),
        "rated_candidates": query([R1, candidates], "SELECT c.user_id, c.item_id FROM c SEMI JOIN r1 USING (user_id, item_id)"),
        "recommend_top5": query(
            [
                *fit,
                f"d AS (SELECT u.id AS user_id, m.id AS item_id, {PREDICTION} AS prediction FROM {dense})",
                "k AS (SELECT d.*, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) AS pos FROM d ANTI JOIN r1 USING (user_id, item_id))",
            ],
            f"SELECT user_id, item_id, CAST(pos AS INTEGER) AS rank, {r6('prediction', 'prediction')} FROM k WHERE pos <= 5",
        ),
        "evaluate_mse": query([*fit, errors(last)], MSE),
        "dense_file_roundtrip": query(fit, per_user_dense),
        "dense_file_mse": query([*fit, errors(last)], MSE),
        "factors_save_load": factor_rows,
        "stream_latest_ratings": f"WITH {R2} SELECT user_id, item_id, rating FROM r1",
        "stream_rating_counts": f"WITH {R2_EVENTS} SELECT item_id AS id, COUNT(*) AS n, CAST(SUM(rating) AS BIGINT) AS total FROM ev GROUP BY 1",
        "stream_profile": f"WITH {R2_EVENTS} "
        f"SELECT e.rating, COUNT(*) AS ratings, {r6('AVG(e.value)', 'mean')}, CAST(1 AS INTEGER) AS users_close, "
        "CAST(1 AS INTEGER) AS items_close, CAST(1 AS INTEGER) AS cells_close "
        "FROM (SELECT rating, rating AS value FROM ev UNION ALL SELECT CAST(0 AS SMALLINT), rating FROM ev) e GROUP BY 1",
        "stream_rating_lists": f"WITH {R2} SELECT item_id AS id, user_id AS other_id, rating FROM r1",
        "fold_in_users": query(
            [
                *fit,
                "turned AS (SELECT user_id, item_id, 6 - rating AS rating FROM r1 JOIN customer ON c_custkey = user_id WHERE c_nationkey < 3)",
                systems("s_turned", "user", f"m{last}", "turned"),
                solved("u_turned", "s_turned"),
            ],
            f"SELECT u.id, CAST(CASE WHEN t.id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS solved, "
            f"{r6('COALESCE(t.f0, u.f0)', 'f0')}, {r6('COALESCE(t.f1, u.f1)', 'f1')} FROM u{last} u LEFT JOIN u_turned t ON t.id = u.id",
        ),
        "stream_refit_mse": query([*als(ratings=R2), errors(last)], MSE),
    }
    # The same results by the paths that larger tables take.
    for name, as_in in (
        ("normal_equations_item_batches", "normal_equations_item"),
        ("half_step_item_batches", "half_step_item"),
        ("half_step_shuffle_batches", "half_step_item"),
        ("half_step_blocks_batches", "half_step_item"),
        ("half_step_conjugate", "half_step_item"),
        ("half_step_conjugate_blocks", "half_step_item"),
        ("als_conjugate_factors", "als_blocks_factors"),
        ("als_batches_factors", "als_blocks_factors"),
        ("als_bucketed_factors", "als_blocks_factors"),
        ("predict_pairs_spread", "predict_pairs"),
        ("evaluate_spread", "evaluate_mse"),
        ("missing_vectors_spread", "missing_vectors"),
        ("predict_dense_grid", "predict_dense"),
        ("recommend_grid", "recommend_top5"),
        ("in_blocks_split", "in_blocks_item"),
        ("stream_refit_tail_mse", "stream_refit_mse"),
        ("stream_headered", "headered_roundtrip"),
        ("recommend_pruned", "recommend_top5"),
        ("als_resumed_factors", "factors_save_load"),
    ):
        known[name] = known[as_in]
    known["als_rank20_gradient"] = query(
        [R1],
        "SELECT DISTINCT user_id, CAST(q AS INTEGER) AS feature, CAST(0 AS DOUBLE) AS gradient "
        "FROM r1 CROSS JOIN (SELECT unnest(range(20)) AS q)",
    )
    known["fit_metrics_checked"] = query(
        [R1],
        " UNION ALL ".join(
            f"SELECT CAST({i} AS INTEGER) AS iteration, '{s}' AS side, COUNT(DISTINCT {s}_id) AS rows, "
            "CAST(1 AS INTEGER) AS timed FROM r1"
            for i in range(1, last + 1)
            for s in ("user", "item")
        ),
    )
    held = f"(user_id * CAST(7919 AS BIGINT) + item_id * CAST(104729 AS BIGINT)) % 10007 < {int(HELD_OUT_SHARE * 10007)}"
    split = [R1.replace("r1 AS", "cells AS", 1), f"r1 AS (SELECT * FROM cells WHERE NOT {held})"]
    mse = "AVG((r.rating - {0}) * (r.rating - {0}))".format(PREDICTION)
    both = [
        f"""SELECT {i} AS i, (SELECT {mse} FROM r1 r JOIN u{i} u ON u.id = r.user_id JOIN m{i} m ON m.id = r.item_id) AS train,
        (SELECT {mse} FROM cells r JOIN u{i} u ON u.id = r.user_id JOIN m{i} m ON m.id = r.item_id WHERE {held}) AS held"""
        for i in range(1, MOST_ITERATIONS + 1)
    ]
    known["convergence_stop"] = query(
        [
            *split,
            *als(MOST_ITERATIONS, R1)[1:],
            f"scored AS ({' UNION ALL '.join(both)})",
            "ruled AS (SELECT *, CASE WHEN LAG(held) OVER (ORDER BY i) IS NULL THEN 1 "
            f"WHEN held < LAG(held) OVER (ORDER BY i) * (1 - {STOP_GAIN}) THEN 1 ELSE 0 END AS improved FROM scored)",
        ],
        f"SELECT CAST(i AS INTEGER) AS iteration, {r6('train', 'train_mse')}, {r6('held', 'held_out_mse')}, "
        "CAST(improved AS INTEGER) AS improved FROM ruled r "
        "WHERE NOT EXISTS (SELECT 1 FROM ruled e WHERE e.i < r.i AND e.improved = 0)",
    )
    known["compare_builtin_checked"] = query(
        [R1],
        "SELECT engine, (SELECT COUNT(*) FROM r1) AS n, CAST(1 AS INTEGER) AS close "
        "FROM (VALUES ('ridgeline'), ('builtin')) AS t(engine)",
    )
    return known
