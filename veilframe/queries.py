"""One query per operator over the driver's tables, each with its SQL oracle.

Releases draw fixed noise (see ``testing``), so that SQL can compute them too.
"""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.apps import geo, graph, ml, text
from veilframe.operators.frame import PrivateFrame
from veilframe.operators.release import gap_table
from veilframe.plans.agents import Agent, AuditAgent, BudgetAgent
from veilframe.plans.guard import Guard, GuardError
from veilframe.plans.noise import NoiseSource
from veilframe.sources import maps, readers
from veilframe.sources.readers import lines_of, table, words
from veilframe.sources.storage import shared_folder
from veilframe.testing import FixedUniform, reveal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LN2 = "ln(2)"
DIMS = 64
CENTRES = [[0.05 * ((i + j) % 3 - 1) for j in range(64)] for i in range(3)]
WEIGHTS = [0.1 if j % 2 else -0.1 for j in range(64)]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def private(spark: SparkSession, sf: str, name: str, **options) -> PrivateFrame:
    return PrivateFrame(table(spark, sf, name), noise=FixedUniform(), **options)


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def average(tally: str, n: str, eps: float) -> str:
    """The truncated Laplace draw at u = 0.75 around tally / n, as SQL."""
    mu, b = f"({tally} / {n})", f"(2.0 / ({eps} * {n}))"
    below = lambda x: f"(CASE WHEN {x} < {mu} THEN 0.5 * exp(({x} - {mu}) / {b}) ELSE 1 - 0.5 * exp(-({x} - {mu}) / {b}) END)"
    p = f"({below('-1.0')} + 0.75 * ({below('1.0')} - {below('-1.0')}))"
    return f"least(1.0, greatest(-1.0, CASE WHEN {p} < 0.5 THEN {mu} + {b} * ln(greatest(2 * {p}, 1e-300)) ELSE {mu} - {b} * ln(greatest(2 * (1 - {p}), 1e-300)) END))"


def average_sql(tally: str, n: str, eps: float) -> str:
    return f"round({average(tally, n, eps)}, 6)"


# ---- record-wise, first rows ------------------------------------------------
@query("where_count", f"SELECT round(count(*) + 10 * {LN2}, 6) AS noisy_count FROM lineitem WHERE l_quantity > 25")
def where_count(spark, sf):
    n = private(spark, sf, "lineitem").where(F.col("l_quantity") > 25).noisy_count(0.1)
    return rows(spark, [(round(n, 6),)], "noisy_count double")


@query("flagship_partition", f"SELECT k AS flag, round(count(l_returnflag) + 2 * {LN2}, 6) AS noisy_count FROM (VALUES ('A'), ('N'), ('R')) t(k) LEFT JOIN lineitem ON l_returnflag = k GROUP BY k")
def flagship_partition(spark, sf):
    frame = PrivateFrame(table(spark, sf, "lineitem"), BudgetAgent(1.0), noise=FixedUniform())
    counts = frame.partition(["A", "N", "R"], "l_returnflag").noisy_counts(0.5)
    return rows(spark, [(k, round(v, 6)) for k, v in counts.items()], "flag string, noisy_count double")


@query("select_project", "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def select_project(spark, sf):
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net")
    return reveal(private(spark, sf, "lineitem").select("l_orderkey", net))


@query("flat_map_k", "SELECT unnest(list_slice(string_split(text, ' '), 1, 5)) AS word FROM documents")
def flat_map_k(spark, sf):
    return reveal(private(spark, sf, "documents").flat_map(5, words("text"), "word"))


@query("take", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def take(spark, sf):
    return reveal(private(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").take(100, ["-o_totalprice", "o_orderkey"]))


@query("skip", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey OFFSET 100")
def skip(spark, sf):
    return reveal(private(spark, sf, "orders").select("o_orderkey", "o_custkey").skip(100, "o_custkey"))


# ---- set operations -----------------------------------------------------------
def _sides(spark, sf):
    one = private(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    two = private(spark, sf, "supplier").where(F.col("s_nationkey") > 10).select(F.col("s_nationkey").alias("k"))
    return one, two


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_nationkey > 10"


@query("concat", f"{_A} UNION ALL {_B}")
def concat(spark, sf):
    one, two = _sides(spark, sf)
    return reveal(one.concat(two))


@query("union", f"{_A} UNION {_B}")
def union(spark, sf):
    one, two = _sides(spark, sf)
    return reveal(one.union(two))


@query("intersect", f"{_A} INTERSECT {_B}")
def intersect(spark, sf):
    one, two = _sides(spark, sf)
    return reveal(one.intersect(two))


@query("except", f"{_A} EXCEPT {_B}")
def except_(spark, sf):
    one, two = _sides(spark, sf)
    return reveal(one.except_(two))


@query("distinct", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def distinct(spark, sf):
    return reveal(private(spark, sf, "orders").select("o_custkey", "o_orderpriority").distinct())


@query("distinct_k", "SELECT o_custkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority) <= 2")
def distinct_k(spark, sf):
    return reveal(private(spark, sf, "orders").select("o_custkey", "o_orderpriority").distinct(2))


@query("distinct_k_key", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3")
def distinct_k_key(spark, sf):
    return reveal(private(spark, sf, "orders").select("o_custkey", "o_orderkey").distinct(3, by="o_custkey", order_by="o_orderkey"))


# ---- grouping and joins ------------------------------------------------------------
@query("group_by_agg", "SELECT event_type, count(*) AS n, round(max(value), 6) AS top FROM events GROUP BY event_type")
def group_by_agg(spark, sf):
    groups = private(spark, sf, "events").group_by("event_type")
    return reveal(groups.agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("top")))


@query("group_items", "SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS first_line FROM lineitem GROUP BY l_orderkey")
def group_items(spark, sf):
    lines = private(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").group_by("l_orderkey").items("l_linenumber")
    size = F.size("items").cast("long").alias("n")
    return reveal(lines.select("l_orderkey", size, F.get("items", F.lit(0))["l_linenumber"].alias("first_line")))


_ORDERS = "SELECT o_custkey AS key, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey"
_CUSTOMERS = "SELECT c_custkey AS key, max(c_acctbal) AS balance FROM customer GROUP BY c_custkey"


@query("group_join_pairs", f"SELECT key, n, total, balance FROM ({_ORDERS}) JOIN ({_CUSTOMERS}) USING (key)")
def group_join_pairs(spark, sf):
    orders, customers = private(spark, sf, "orders"), private(spark, sf, "customer")
    mine = [F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")]
    return reveal(orders.join_groups(customers, "o_custkey", "c_custkey", mine, [F.max("c_acctbal").alias("balance")]))


@query(
    "bounded_join",
    """WITH o AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3),
    c AS (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY c_name) <= 1)
    SELECT o_orderkey, c_name FROM o JOIN c ON o_custkey = c_custkey""",
)
def bounded_join(spark, sf):
    orders, customers = private(spark, sf, "orders"), private(spark, sf, "customer")
    pick = [F.col("l.o_orderkey").alias("o_orderkey"), F.col("r.c_name").alias("c_name")]
    return reveal(orders.join(customers, "o_custkey", "c_custkey", 3, 1, pick, "o_orderkey", "c_name"))


@query("group_join_left_record", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def group_join_left_record(spark, sf):
    joined = private(spark, sf, "customer").left_join_list(table(spark, sf, "orders"), "c_custkey", "o_custkey", [F.count(F.lit(1)).alias("n")], {"n": 0})
    return reveal(joined.select("c_custkey", "n"))


@query(
    "group_join_left_groups",
    """SELECT c_nationkey AS key, customers, coalesce(suppliers, 0) AS suppliers
    FROM (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey)
    LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY s_nationkey) ON c_nationkey = s_nationkey""",
)
def group_join_left_groups(spark, sf):
    customers, suppliers = private(spark, sf, "customer"), private(spark, sf, "supplier")
    count = F.count(F.lit(1))
    return reveal(customers.left_join_groups(suppliers, "c_nationkey", "s_nationkey", [count.alias("customers")], [count.alias("suppliers")], {"suppliers": 0}))


# ---- releases -------------------------------------------------------------------------
_SIGNED = "greatest(-1.0, least(1.0, l_discount * 30 - 1.5))"


@query("noisy_sum", f"SELECT round(sum({_SIGNED}) + 2 * {LN2}, 4) AS noisy_sum FROM lineitem")
def noisy_sum(spark, sf):
    value = private(spark, sf, "lineitem").noisy_sum(0.5, F.col("l_discount") * 30 - 1.5)
    return rows(spark, [(round(value, 4),)], "noisy_sum double")


@query("noisy_average", f"SELECT {average_sql('sum(' + _SIGNED + ')', 'count(*)', 0.001)} AS noisy_average FROM lineitem")
def noisy_average(spark, sf):
    value = private(spark, sf, "lineitem").noisy_average(0.001, F.col("l_discount") * 30 - 1.5)
    return rows(spark, [(round(value, 6),)], "noisy_average double")


_PRICE = "greatest(0.0, least(1.0, l_extendedprice / 100000))"
_GAPS = f"""g AS (SELECT {_PRICE} AS v, count(*) AS m FROM lineitem GROUP BY 1),
    gaps AS (SELECT lag(v, 1, 0.0) OVER w AS lo, v AS hi, coalesce(sum(m) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below FROM g WINDOW w AS (ORDER BY v)
      UNION ALL SELECT coalesce(max(v), 0.0), 1.0, coalesce(sum(m), 0)::BIGINT FROM g)"""


@query("order_stat_gaps", f"WITH {_GAPS} SELECT lo, hi, below FROM gaps WHERE hi > lo")
def order_stat_gaps(spark, sf):
    return gap_table(table(spark, sf, "lineitem"), F.col("l_extendedprice") / 100000).select("lo", "hi", "below")


@query(
    "noisy_median",
    f"""WITH {_GAPS}, lw AS (SELECT lo, hi, ln(hi - lo) - 0.01 * abs(0.5 * (SELECT count(*) FROM lineitem) - below) AS lw FROM gaps WHERE hi > lo),
    c AS (SELECT lo, hi, sum(exp(lw - (SELECT max(lw) FROM lw))) OVER (ORDER BY lo ROWS UNBOUNDED PRECEDING) AS run FROM lw)
    SELECT round(lo + (hi - lo) * 0.75, 4) AS noisy_median FROM c WHERE run > 0.75 * (SELECT max(run) FROM c) ORDER BY lo LIMIT 1""",
)
def noisy_median(spark, sf):
    value = private(spark, sf, "lineitem").noisy_median(0.01, F.col("l_extendedprice") / 100000)
    return rows(spark, [(round(value, 4),)], "noisy_median double")


def _order_sql(fraction: float) -> str:
    return f"""(WITH lw AS (SELECT lo, hi, ln(hi - lo) - 0.01 * abs({fraction} * (SELECT count(*) FROM lineitem) - below) AS lw FROM gaps WHERE hi > lo),
      c AS (SELECT lo, hi, sum(exp(lw - (SELECT max(lw) FROM lw))) OVER (ORDER BY lo ROWS UNBOUNDED PRECEDING) AS run FROM lw)
      SELECT {fraction}::DOUBLE AS fraction, round(lo + (hi - lo) * 0.75, 4) AS value FROM c WHERE run > 0.75 * (SELECT max(run) FROM c) ORDER BY lo LIMIT 1)"""


_FRACTIONS = (0.0, 0.25, 0.75, 1.0)


@query("noisy_order_statistic", f"WITH {_GAPS} {' UNION ALL '.join(map(_order_sql, _FRACTIONS))}")
def noisy_order_statistic(spark, sf):
    frame = private(spark, sf, "lineitem")
    got = [(f, round(frame.noisy_order_statistic(0.01, f, F.col("l_extendedprice") / 100000), 4)) for f in _FRACTIONS]
    return rows(spark, got, "fraction double, value double")


@query(
    "select_best",
    """SELECT k AS best FROM (VALUES ('A', 0), ('N', 1), ('R', 2), ('Z', 3)) t(k, i)
    LEFT JOIN (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag) ON l_returnflag = k
    ORDER BY coalesce(n, 0) DESC, i DESC LIMIT 1""",
)
def select_best(spark, sf):
    score = lambda c: F.when(F.col("l_returnflag") == c, 1.0).otherwise(0.0)
    return rows(spark, [(private(spark, sf, "lineitem").select_best(0.1, ["A", "N", "R", "Z"], score),)], "best string")


@query("partition_counts", f"SELECT k AS event_type, round(count(event_type) + 10 * {LN2}, 6) AS noisy_count FROM (VALUES ('view'), ('click'), ('purchase'), ('unseen')) t(k) LEFT JOIN events ON event_type = k GROUP BY k")
def partition_counts(spark, sf):
    counts = private(spark, sf, "events").partition(["view", "click", "purchase", "unseen"], "event_type").noisy_counts(0.1)
    return rows(spark, [(k, round(v, 6)) for k, v in counts.items()], "event_type string, noisy_count double")


@query(
    "nested_partition",
    f"""SELECT f, s, round(count(l_returnflag) + 10 * {LN2}, 6) AS noisy_count FROM (VALUES ('A'), ('N'), ('R'), ('Z')) a(f)
    CROSS JOIN (VALUES ('F'), ('O')) b(s) LEFT JOIN lineitem ON l_returnflag = f AND l_linestatus = s GROUP BY f, s""",
)
def nested_partition(spark, sf):
    cells = [(f, s) for f in "ANRZ" for s in "FO"]
    counts = private(spark, sf, "lineitem").partition(cells, ["l_returnflag", "l_linestatus"]).noisy_counts(0.1)
    return rows(spark, [(*k, round(v, 6)) for k, v in counts.items()], "f string, s string, noisy_count double")


@query(
    "privacy_ledger",
    """SELECT * FROM (VALUES (1::BIGINT, 'where', 0.1::DOUBLE, 0.1::DOUBLE), (2, 'group_by', 0.2, 0.3), (3, 'flat_map', 0.5, 0.8),
    (4, 'concat_self', 0.1, 0.9), (5, 'concat_self', 0.1, 1.0), (6, 'take', 0.2, 1.2), (7, 'partition', 0.3, 1.5)) t(step, name, delta, total)""",
)
def privacy_ledger(spark, sf):
    audit = AuditAgent("session", BudgetAgent(100.0))
    events = private(spark, sf, "events", agent=audit)
    steps = []

    def run(name, release):
        before = len(audit.ledger)
        release()
        steps.extend(name for _ in audit.ledger[before:])

    run("where", lambda: events.where(F.col("value") > 0).noisy_count(0.1))
    run("group_by", lambda: events.group_by("user_id").sizes().noisy_count(0.1))
    run("flat_map", lambda: events.flat_map(5, F.array("event_type")).noisy_count(0.1))
    run("concat_self", lambda: events.concat(events).noisy_count(0.1))
    run("take", lambda: events.take(10, "event_id").noisy_count(0.1))
    run("partition", lambda: events.partition(["view", "click"], "event_type").noisy_counts(0.3))
    return rows(spark, [(i, name, round(d, 9), round(t, 9)) for name, (i, d, t) in zip(steps, audit.ledger, strict=True)], "step long, name string, delta double, total double")


# ---- learning -------------------------------------------------------------------------
_VEC = "SELECT list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings"


def _vectors(spark, sf) -> PrivateFrame:
    return private(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("vec"))


def _sql_vector(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def _cells(values: list[float]) -> list[tuple[int, float]]:
    return [(i, round(v, 6)) for i, v in enumerate(values)]


_NEAREST = ", ".join(f"list_sum(list_transform(list_zip(vec, {_sql_vector(c)}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))" for c in CENTRES)
_LABELLED = f"SELECT vec AS vector, CASE WHEN list_position(d, list_min(d)) = 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS label FROM (SELECT vec, [{_NEAREST}] AS d FROM ({_VEC}))"
_ODDS = f"list_dot_product(vector, {_sql_vector(WEIGHTS)})"


def _axis(source: str, value: str, noise: Callable[[str, str], str], add: bool) -> str:
    added = f"({_sql_vector(WEIGHTS)})[i + 1] + " if add else ""
    return f"SELECT i, round({added}{noise('sum(v)', 'count(*)')}, 6) AS value FROM (SELECT i, {value} AS v FROM ({source}), (SELECT unnest(range(0, 64)) AS i)) GROUP BY i"


@query("ml_mean", _axis(_VEC, "vec[i + 1]", lambda s, n: average_sql(s, n, 0.1), False))
def ml_mean(spark, sf):
    return rows(spark, _cells(ml.mean(_vectors(spark, sf), "vec", 64, 0.1)), "i long, value double")


@query("ml_covariance", f"SELECT i, j, {average_sql('sum(v)', 'count(*)', 8.0)} AS value FROM (SELECT i, j, vec[i + 1] * vec[j + 1] AS v FROM ({_VEC}), (SELECT unnest(range(0, {DIMS})) AS i), (SELECT unnest(range(0, {DIMS})) AS j)) GROUP BY i, j")
def ml_covariance(spark, sf):
    got = ml.covariance(_vectors(spark, sf), "vec", DIMS, 8.0)
    return rows(spark, [(i, j, round(got[i][j], 6)) for i in range(DIMS) for j in range(DIMS)], "i long, j long, value double")


@query("ml_centre", f"SELECT round(list_sum(list_transform(vec, lambda x: x - 0.1)), 6) AS total FROM ({_VEC})")
def ml_centre(spark, sf):
    moved = ml.centre(_vectors(spark, sf), "vec", [0.1] * 64)
    return reveal(moved.select(F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total")))


@query(
    "kmeans_step",
    f"""WITH p AS (SELECT list_position(d, list_min(d)) - 1 AS c, vec FROM (SELECT vec, [{_NEAREST}] AS d FROM ({_VEC}))),
    x AS (SELECT c, i, vec[i + 1] AS v FROM p, (SELECT unnest(range(0, 64)) AS i))
    SELECT c::BIGINT AS c, i, {average_sql('sum(v)', 'count(*)', 0.1)} AS value FROM x GROUP BY c, i""",
)
def kmeans_step(spark, sf):
    centres = ml.kmeans_step(_vectors(spark, sf), "vec", CENTRES, 0.1)
    return rows(spark, [(c, i, v) for c, centre in enumerate(centres) for i, v in _cells(centre)], "c long, i long, value double")


def _examples(spark, sf) -> PrivateFrame:
    return ml.label_by_nearest(_vectors(spark, sf), "vec", CENTRES)


@query("perceptron_step", _axis(f"SELECT * FROM ({_LABELLED}) WHERE label * {_ODDS} < 0", "label * vector[i + 1]", lambda s, n: average_sql(s, n, 0.1), True))
def perceptron_step(spark, sf):
    return rows(spark, _cells(ml.perceptron_step(_examples(spark, sf), WEIGHTS, 0.1)), "i long, value double")


@query(
    "svm_step",
    _axis(
        f"SELECT * FROM ({_LABELLED}) WHERE label * {_ODDS} < 1 UNION ALL SELECT {_sql_vector(WEIGHTS)}, -1.0 FROM range(10)",
        "label * vector[i + 1]",
        lambda s, n: average_sql(s, n, 0.1),
        True,
    ),
)
def svm_step(spark, sf):
    return rows(spark, _cells(ml.svm_step(spark, _examples(spark, sf), WEIGHTS, 0.1)), "i long, value double")


@query("logistic_step", _axis(f"SELECT vector, (label + 1) / 2 - 1 / (1 + exp(-{_ODDS})) AS error FROM ({_LABELLED})", "greatest(-1.0, least(1.0, error * vector[i + 1]))", lambda s, n: f"{s} + 10 * {LN2}", True))
def logistic_step(spark, sf):
    return rows(spark, _cells(ml.logistic_step(_examples(spark, sf), WEIGHTS, 0.1)), "i long, value double")


@query("ml_error_rate", f"SELECT {average_sql('sum(e)', 'count(*)', 0.1)} AS error_rate FROM (SELECT CASE WHEN label * {_ODDS} < 0 THEN 1.0 ELSE 0.0 END AS e FROM ({_LABELLED}))")
def ml_error_rate(spark, sf):
    return rows(spark, [(round(ml.error_rate(_examples(spark, sf), WEIGHTS, 0.1), 6),)], "error_rate double")


# ---- graph ------------------------------------------------------------------------------
BOUND = 10
_EDGES = "SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem"
_BOUNDED = f"""e0 AS ({_EDGES}),
    e1 AS (SELECT * FROM e0 QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= {BOUND}),
    e2 AS (SELECT * FROM e1 QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src) <= {BOUND}),
    e AS (SELECT src, dst FROM e2 UNION SELECT dst, src FROM e2)"""
_LAST = lambda name, n, bound, path: f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {path}[{n}] ORDER BY {path}) <= {bound})"
_PATHS = f"""{_BOUNDED}, p1 AS (SELECT [src, dst] AS p FROM e),
    p2 AS (SELECT list_concat(a.p, list_slice(b.p, 2, 2)) AS p FROM {_LAST('p1', 2, BOUND, 'p')} a JOIN {_LAST('p1', 1, BOUND, 'p')} b ON a.p[2] = b.p[1]),
    p3 AS (SELECT list_concat(a.p, list_slice(b.p, 2, 2)) AS p FROM {_LAST('p2', 3, BOUND * BOUND, 'p')} a JOIN {_LAST('p1', 1, BOUND, 'p')} b ON a.p[3] = b.p[1])"""


def _edges(spark, sf) -> PrivateFrame:
    return private(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


@query("degree_distribution", f"WITH d AS (SELECT count(*) AS n FROM ({_EDGES}) GROUP BY src) SELECT k::BIGINT AS degree, round(count(n) + 10 * {LN2}, 6) AS noisy_count FROM (SELECT unnest(range(0, 20)) AS k) LEFT JOIN d ON n = k GROUP BY k")
def degree_distribution(spark, sf):
    counts = graph.degree_distribution(_edges(spark, sf))
    return rows(spark, [(k, round(v, 6)) for k, v in counts.items()], "degree long, noisy_count double")


@query("bound_degree", f"WITH {_BOUNDED} SELECT src, dst FROM e")
def bound_degree(spark, sf):
    return reveal(graph.bound_degree(_edges(spark, sf), BOUND))


@query("bound_degree_cheap", f"WITH {_BOUNDED} SELECT src, dst FROM e")
def bound_degree_cheap(spark, sf):
    return reveal(graph.bound_degree(_edges(spark, sf), BOUND, cheap=True))


@query(
    "assortativity",
    f"""WITH {_BOUNDED}, n AS (SELECT src AS node, count(*) AS n FROM e GROUP BY src),
    one AS (SELECT f.src, f.dst, n.n AS d1 FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= {2 * BOUND}) f JOIN n ON f.src = n.node),
    two AS (SELECT f.d1, n.n AS d2 FROM (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src) <= {2 * BOUND}) f JOIN n ON f.dst = n.node)
    SELECT a AS d1, b AS d2, round(count(two.d1) + 10 * {LN2}, 6) AS noisy_count
    FROM (SELECT unnest(range(8, 13)) AS a) CROSS JOIN (SELECT unnest(range(8, 13)) AS b) LEFT JOIN two ON two.d1 = a AND two.d2 = b GROUP BY a, b""",
)
def assortativity(spark, sf):
    edges = graph.bound_degree(_edges(spark, sf), BOUND, cheap=True)
    counts = graph.assortativity(edges, range(8, 13), 2 * BOUND, 0.1)
    return rows(spark, [(*k, round(v, 6)) for k, v in counts.items()], "d1 long, d2 long, noisy_count double")


@query("extend_paths", f"WITH {_PATHS} SELECT p[1] AS a, p[2] AS b, p[3] AS c FROM p2")
def extend_paths(spark, sf):
    paths = graph.as_paths(graph.bound_degree(_edges(spark, sf), BOUND, cheap=True))
    return reveal(graph.extend_paths(paths, paths, BOUND, BOUND).select(*[F.get("path", F.lit(i)).alias(n) for i, n in enumerate("abc")]))


@query("triangles", f"WITH {_PATHS} SELECT round((SELECT count(*) FROM p3 WHERE p[1] = p[4]) + 10 * {LN2}, 6) AS closed_walks, round((SELECT count(*) FROM p2) + 10 * {LN2}, 6) AS two_paths")
def triangles(spark, sf):
    closed, two = graph.triangle_ratio(graph.bound_degree(_edges(spark, sf), BOUND, cheap=True), BOUND, 0.1)
    return rows(spark, [(round(closed, 6), round(two, 6))], "closed_walks double, two_paths double")


_LEVELS = [(0.85 / BOUND) ** i for i in range(3)]


@query(
    "path_pagerank",
    f"WITH {_PATHS} SELECT round("
    + " + ".join(f"{w} * ((SELECT count(*) FROM p{i + 1} WHERE p[{i + 2}] % 10 = 0) + {LN2} / (0.1 * {w}))" for i, w in enumerate(_LEVELS))
    + ", 4) AS score",
)
def path_pagerank(spark, sf):
    edges = graph.bound_degree(_edges(spark, sf), BOUND, cheap=True)
    return rows(spark, [(round(graph.path_pagerank(edges, 10, BOUND), 4),)], "score double")


# ---- geo and text ----------------------------------------------------------------------
DEPTH = 12
_POINTS = "SELECT '' AS prefix, l_extendedprice / 50000 - 1 AS a, l_quantity / 25.5 - 1 AS b FROM lineitem"


def _level_sql(level: int) -> str:
    """Open cells and points of the next level: each cell's noisy mean sign divides its points."""
    mean = f"CASE WHEN coalesce(k, 0) = 0 THEN 0.5 ELSE {average('s', 'k', 1.0 / (level + 1))} END"
    return f"""m{level} AS MATERIALIZED (SELECT prefix, n, {mean} AS mean FROM (SELECT prefix, n FROM c{level} WHERE n > 0)
      LEFT JOIN (SELECT prefix, sum(sign(a))::DOUBLE AS s, count(*)::DOUBLE AS k FROM r{level} GROUP BY prefix) USING (prefix)),
    c{level + 1} AS MATERIALIZED (SELECT prefix || '0' AS prefix, round_even((n - mean * n) / 2, 0)::BIGINT AS n FROM m{level}
      UNION ALL SELECT prefix || '1', round_even((n + mean * n) / 2, 0)::BIGINT FROM m{level}),
    r{level + 1} AS MATERIALIZED (SELECT prefix || CASE WHEN a > 0 THEN '1' ELSE '0' END AS prefix, b AS a, CASE WHEN a > 0 THEN 2 * a - 1 ELSE 2 * a + 1 END AS b FROM r{level})"""


@query(
    "geo_quadtree",
    f"WITH r0 AS MATERIALIZED ({_POINTS}), c0 AS MATERIALIZED (SELECT '' AS prefix, round_even(count(*) + {LN2}, 0)::BIGINT AS n FROM lineitem), "
    + ", ".join(_level_sql(i) for i in range(DEPTH))
    + f" SELECT prefix, n AS points FROM c{DEPTH} WHERE n > 0",
)
def geo_quadtree(spark, sf):
    points = private(spark, sf, "lineitem").select((F.col("l_extendedprice") / 50000 - 1).alias("x0"), (F.col("l_quantity") / 25.5 - 1).alias("x1"))
    return geo.leaves_frame(spark, geo.quadtree(points, None, DEPTH))


@query(
    "geo_cells",
    """SELECT p AS prefix, lo0, hi0, lo1, hi1 FROM (VALUES ('', -1.0::DOUBLE, 1.0::DOUBLE, -1.0::DOUBLE, 1.0::DOUBLE), ('1', 0.0, 1.0, -1.0, 1.0), ('10', 0.0, 1.0, -1.0, 0.0),
    ('0111', -0.5, 0.0, 0.5, 1.0), ('00000', -1.0, -0.75, -1.0, -0.5)) t(p, lo0, hi0, lo1, hi1)""",
)
def geo_cells(spark, sf):
    return rows(spark, [(p, *geo.cell_of(p)) for p in ("", "1", "10", "0111", "00000")], "prefix string, lo0 double, hi0 double, lo1 double, hi1 double")


@query("geo_map", "SELECT count(*) AS dots, true AS inside FROM nation")
def geo_map(spark, sf):
    """A page with a dot for every nation's cell, and the same dots as a table."""
    cells = [(format(r["n_nationkey"], "05b"), 1) for r in table(spark, sf, "nation").collect()]
    spots = list(geo.scatter(cells, random.Random(1)))
    page, dots = maps.points_page(spots), maps.points_frame(spark, spots)
    inside = F.min((F.abs("lat") <= 90) & (F.abs("lon") <= 180) & (F.length("prefix") == 5)) & F.lit(page.count("<circle") == len(spots))
    return dots.agg(F.count(F.lit(1)).alias("dots"), inside.alias("inside"))


@query(
    "geo_coordinates",
    """SELECT round(((c_custkey % 180) - 90) / 90.0, 6) AS x0, round(((c_custkey % 360) - 180) / 180.0, 6) AS x1
    FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""",
)
def geo_coordinates(spark, sf):
    key = lambda name: F.concat(F.lit("10.0."), F.col(name).cast("string"))
    searches = private(spark, sf, "orders").select(F.concat(key("o_custkey"), F.lit(".7"), F.repeat(F.lit(","), 20), F.lit("Cheap Flights")).alias("value"))
    customer = private(spark, sf, "customer")
    places = customer.select(
        F.concat_ws("\t", F.concat(key("c_custkey"), F.lit(".0")), ((F.col("c_custkey") % 180) - 90).cast("string"), ((F.col("c_custkey") % 360) - 180).cast("string")).alias("value")
    )
    found = geo.search_coordinates(searches, places, "cheap flights")
    return reveal(found.select(F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1")))


_LINES = "SELECT unnest(string_split(text, chr(10))) AS value FROM documents"


def _lines(spark, sf) -> PrivateFrame:
    return PrivateFrame(lines_of(table(spark, sf, "documents")), noise=FixedUniform())


@query("text_lines", f"SELECT round(count(*) + {LN2}, 6) AS noisy_count FROM ({_LINES})")
def text_lines(spark, sf):
    return rows(spark, [(round(text.line_count(_lines(spark, sf)), 6),)], "noisy_count double")


@query("text_contains", f"SELECT round(count(*) + {LN2}, 6) AS noisy_count FROM ({_LINES}) WHERE contains(value, ',')")
def text_contains(spark, sf):
    return rows(spark, [(round(text.lines_with(_lines(spark, sf), ","), 6),)], "noisy_count double")


@query("text_words", f"SELECT k AS words, round(count(value) + 10 * {LN2}, 6) AS noisy_count FROM (SELECT unnest(range(0, 10)) AS k) LEFT JOIN ({_LINES}) ON len(string_split(value, ' ')) = k GROUP BY k")
def text_words(spark, sf):
    counts = text.words_per_line(_lines(spark, sf))
    return rows(spark, [(k, round(v, 6)) for k, v in counts.items()], "words long, noisy_count double")



# ---- sources, noise and policies ---------------------------------------------------------
def _text_file(spark, sf, gzip: bool) -> str:
    """Names of nations as a text file in the folder that driver and executors share."""
    path = f"{shared_folder(spark)}/veilframe/nations-{uuid.uuid4().hex}"
    table(spark, sf, "nation").select("n_name").write.option("compression", "gzip" if gzip else "none").text(path)
    return path


@query("source_text_lines", "SELECT n_name AS value FROM nation")
def source_text_lines(spark, sf):
    return reveal(PrivateFrame(readers.text_lines(spark, _text_file(spark, sf, False))))


@query("source_gzip", f"SELECT round(count(*) + {LN2}, 6) AS noisy_count FROM nation WHERE contains(n_name, 'A')")
def source_gzip(spark, sf):
    frame = PrivateFrame(readers.text_lines(spark, _text_file(spark, sf, True)), noise=FixedUniform())
    return rows(spark, [(round(text.lines_with(frame, "A"), 6),)], "noisy_count double")


@query("source_prefixes", "SELECT DISTINCT substr(n_name, 1, k) AS prefix FROM nation, (SELECT unnest(range(0, 6)) AS k)")
def source_prefixes(spark, sf):
    return readers.prefixes(spark, _text_file(spark, sf, False), 5)


@query("source_vectors", "SELECT 1000 AS n, 8 AS dims, true AS inside, true AS spread")
def source_vectors(spark, sf):
    every = readers.random_vectors(spark, 1000, 8).select(F.posexplode("vec").alias("i", "x"))
    spread = (F.abs(F.avg("x")) < 0.1) & (F.abs(F.stddev("x") - 3**-0.5) < 0.05)
    return every.agg((F.count(F.lit(1)) / 8).cast("int").alias("n"), (F.max("i") + 1).alias("dims"), F.min((F.col("x") >= -1) & (F.col("x") < 1)).alias("inside"), spread.alias("spread"))


@query("source_edges", "SELECT 10000::BIGINT AS n, 1000::BIGINT AS sources, 1000::BIGINT AS targets, true AS inside")
def source_edges(spark, sf):
    inside = F.min(F.col("src").between(0, 999) & F.col("dst").between(0, 999))
    return readers.random_edges(spark, 10_000, 1000).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"), inside.alias("inside"))


class _Fixed(NoiseSource):
    """The library's own draws from a given uniform."""

    def __init__(self, u: float):
        super().__init__()
        self._u = u

    def unit(self) -> float:
        return self._u


@query(
    "noise_draws",
    f"""SELECT u, round(-sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)) * 3.0, 9) AS laplace, round(-2.0 + 5.0 * u, 9) AS uniform,
    round({average('0.6', '2.0', 0.5).replace('0.75', 'u')}, 9) AS truncated FROM (SELECT unnest([0.001, 0.25, 0.4999, 0.5, 0.75, 0.999])::DOUBLE AS u)""",
)
def noise_draws(spark, sf):
    draw = lambda u: (u, round(_Fixed(u).laplace(3.0), 9) + 0.0, round(_Fixed(u).uniform(-2.0, 3.0), 9), round(_Fixed(u).truncated_laplace(0.3, 2.0, -1.0, 1.0), 9))
    return rows(spark, [draw(u) for u in (0.001, 0.25, 0.4999, 0.5, 0.75, 0.999)], "u double, laplace double, uniform double, truncated double")


@query("random_source", "SELECT true AS differ, true AS inside, true AS centred")
def random_source(spark, sf):
    """The system's entropy: draws differ, lie where they should, and centre on zero."""
    source = NoiseSource()
    units, draws = [source.unit() for _ in range(4000)], sorted(source.laplace(1.0) for _ in range(4000))
    return rows(spark, [(len(set(units)) > 3990, all(0 <= u < 1 for u in units), abs(draws[2000]) < 0.2)], "differ boolean, inside boolean, centred boolean")


@query("scalar_functions", "SELECT n_nationkey, substr(n_name, 2, 3) AS part, round_even((n_nationkey - 7) / 2.0, 0)::DOUBLE AS half FROM nation")
def scalar_functions(spark, sf):
    nation = private(spark, sf, "nation")
    return reveal(nation.select("n_nationkey", F.substring("n_name", 2, 3).alias("part"), F.rint((F.col("n_nationkey") - 7) / 2.0).alias("half")))


class _Doubling(Agent):
    """An agent of a user: every charge counts twice."""

    def __init__(self):
        self.total = 0.0

    def _charge(self, eps: float) -> bool:
        self.total += 2 * eps
        return True


class _Named(PrivateFrame):
    """A frame of a user, which all its results are as well."""


class _Positive(Guard):
    """A policy of a user: only filters on ``value`` may stand."""

    def where(self, df, condition):
        if "value" not in str(condition):
            raise GuardError("only value may be asked for")
        return super().where(df, condition)


@query("policies", "SELECT count(*) FILTER (value > 0) AS kept, true AS refused, true AS same_class, true AS base_class, 1.0::DOUBLE AS charged FROM events")
def policies(spark, sf):
    """A user's agent, guard and frame class are kept by every transformation; ``as_base`` leaves the class only."""
    agent = _Doubling()
    frame = _Named(table(spark, sf, "events"), agent, _Positive(), FixedUniform(0.5))
    kept = frame.where(F.col("value") > 0)
    try:
        kept.as_base().where(F.col("user_id") > 0)
        refused = False
    except GuardError:
        refused = True
    n = kept.as_base().materialize().noisy_count(0.5)
    return rows(spark, [(round(n - 2 * math.log(2)), refused, type(kept.select("value")) is _Named, type(kept.as_base()) is PrivateFrame, agent.total)], "kept long, refused boolean, same_class boolean, base_class boolean, charged double")


@query(
    "joins_with_public_tables",
    f"""SELECT 'groups' AS kind, count(*) AS n FROM ({_ORDERS}) JOIN ({_CUSTOMERS}) USING (key)
    UNION ALL SELECT 'bounded', count(*) FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2) JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT 'left', count(*) FROM ({_CUSTOMERS})
    UNION ALL SELECT 'concat', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'union', (SELECT count(*) FROM nation)
    UNION ALL SELECT 'charge', 2 + 2 + 2 + 1 + 1""",
)
def joins_with_public_tables(spark, sf):
    """The public-other forms: only this side pays."""
    audit = AuditAgent("public")
    orders, customers = private(spark, sf, "orders", agent=audit), private(spark, sf, "customer", agent=audit)
    customer, supplier, nation = (table(spark, sf, t) for t in ("customer", "supplier", "nation"))
    one = F.count(F.lit(1)).alias("n")
    frames = {
        "groups": orders.join_groups(customer, "o_custkey", "c_custkey", [one], [F.max("c_acctbal").alias("b")]),
        "bounded": orders.join(customer, "o_custkey", "c_custkey", 2, 1, [F.col("l.o_orderkey")], "o_orderkey", "c_name"),
        "left": customers.left_join_groups(orders.select("o_custkey")._df, "c_custkey", "o_custkey", [one], [F.count(F.lit(1)).alias("m")]),
        "concat": customers.select(F.col("c_nationkey").alias("k")).concat(supplier.select(F.col("s_nationkey").alias("k"))),
        "union": customers.select(F.col("c_nationkey").alias("k")).union(nation.select(F.col("n_nationkey").alias("k"))),
    }
    counts = [(kind, reveal(f).count()) for kind, f in frames.items()]
    for frame in frames.values():
        frame.noisy_count(1.0)
    return rows(spark, [*counts, ("charge", int(audit.total))], "kind string, n long")


assert math.isclose(FixedUniform().laplace(1.0), math.log(2))
