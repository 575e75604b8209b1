"""Transformations, releases, guard and stability on small frames."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilframe import AuditAgent, BudgetAgent, Guard, GuardError, PrivacyDenied, PrivateFrame
from veilframe.functions.ranking import skip_rows
from veilframe.functions.scalars import clamp, nearest
from veilframe.operators.release import gap_table
from veilframe.testing import FixedUniform, reveal

LN2 = math.log(2)


def private(spark, rows, schema="k string, v double", **options):
    return PrivateFrame(spark.createDataFrame(rows, schema), noise=FixedUniform(), **options)


def values(frame):
    return sorted((tuple(r) for r in reveal(frame).collect()), key=repr)


SAMPLE = [("a", 1.0), ("a", 2.0), ("b", -3.0), (None, None), ("b", float("nan")), ("a", 1.0)]


def test_clamp_is_total(spark):
    rows = spark.createDataFrame([(x,) for x in (None, float("nan"), -5.0, 0.3, 7.0, float("inf"))], "x double")
    assert [r[0] for r in rows.select(clamp(F.col("x"), -1, 1)).collect()] == [0.0, 0.0, -1.0, 0.3, 1.0, 1.0]
    assert rows.select(clamp(F.col("x"), 0.5, 1)).first()[0] == 0.5


def test_nearest_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([([0.0, 0.0],), ([1.0, 1.0],)], "v array<double>")
    assert [r[0] for r in rows.select(nearest(F.col("v"), [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])).collect()] == [0, 2]


def test_releases_with_fixed_noise(spark):
    frame = private(spark, SAMPLE)
    assert frame.noisy_count(0.5) == pytest.approx(6 + 2 * LN2)
    assert frame.noisy_sum(1.0, F.col("v")) == pytest.approx(1 + 1 - 1 + 0 + 0 + 1 + LN2)
    assert -1 <= frame.noisy_average(0.1, F.col("v")) <= 1
    empty = frame.where(F.lit(False))
    assert empty.noisy_count(1.0) == pytest.approx(LN2)
    assert empty.noisy_sum(1.0, F.col("v")) == pytest.approx(LN2)
    assert empty.noisy_average(1.0, F.col("v")) == 0.5
    assert empty.noisy_median(1.0, F.col("v")) == 0.75
    assert frame.select_best(1.0, ["x", "a", "z"], lambda c: F.when(F.col("k") == c, 1.0)) == "a"
    assert empty.select_best(1.0, ["x", "y"], lambda c: F.when(F.col("k") == c, 1.0)) == "y"


def test_denied_releases_read_nothing(spark):
    frame = private(spark, SAMPLE, agent=BudgetAgent(0.1))
    with pytest.raises(PrivacyDenied):
        frame.noisy_count(0.2)
    with pytest.raises(ValueError):
        frame.noisy_count(float("nan"))
    with pytest.raises(ValueError):
        frame.select_best(0.1, [], lambda c: F.lit(1.0))
    with pytest.raises(ValueError):
        frame.noisy_order_statistic(0.1, 1.5, F.col("v"))


def test_median_of_extreme_epsilon_does_not_underflow(spark):
    rows = [("a", i / 1000) for i in range(1001)]
    got = private(spark, rows).noisy_median(1000.0, F.col("v"))
    assert abs(got - 0.5) < 0.01


def test_gap_table_against_a_sort(spark):
    rng = random.Random(5)
    data = [rng.choice([rng.random(), 0.0, 1.0, 0.25, 0.2501, 1.7, -2.0]) for _ in range(300)]
    got = {(r.lo, r.hi): r.below for r in gap_table(spark.createDataFrame([(x,) for x in data], "v double"), F.col("v")).collect()}
    held = sorted(min(1.0, max(0.0, x)) for x in data)
    want, last = {}, 0.0
    for i, x in enumerate(held + [1.0]):
        if x > last:
            want[last, x] = i
        last = max(last, x)
    assert got == want


CHARGES = [
    ("where", lambda f: f.where(F.col("v") > 0), 1),
    ("select", lambda f: f.select("k"), 1),
    ("flat_map", lambda f: f.flat_map(3, F.array("k", "k")), 3),
    ("take", lambda f: f.take(2, "v"), 2),
    ("skip", lambda f: f.skip(2, "v"), 1),
    ("distinct", lambda f: f.distinct(), 1),
    ("distinct_k", lambda f: f.distinct(2), 1),
    ("distinct_k_key", lambda f: f.distinct(2, by="k", order_by="v"), 2),
    ("group_by", lambda f: f.group_by("k").sizes(), 2),
    ("concat", lambda f: f.concat(f), 2),
    ("union", lambda f: f.union(f), 2),
    ("intersect", lambda f: f.intersect(f), 2),
    ("except", lambda f: f.except_(f), 2),
    ("join_groups", lambda f: f.join_groups(f, "k", "k", [F.count("v").alias("a")], [F.count("v").alias("b")]), 4),
    ("join", lambda f: f.join(f, "k", "k", 2, 3, [F.col("l.k").alias("k")], "v", "v"), 2 * 3 + 2 * 2),
    ("left_join_groups", lambda f: f.left_join_groups(f, "k", "k", [F.count("v").alias("a")], [F.count("v").alias("b")]), 4),
    ("materialize", lambda f: f.materialize(), 1),
    ("as_base", lambda f: f.as_base(), 1),
]


@pytest.mark.parametrize("name, op, factor", CHARGES, ids=[c[0] for c in CHARGES])
def test_charges(spark, name, op, factor):
    audit = AuditAgent("t")
    op(private(spark, SAMPLE, agent=audit)).noisy_count(0.5)
    assert audit.total == pytest.approx(0.5 * factor)


def test_public_partners_cost_nothing_and_agents_of_tables_are_charged(spark):
    public, other, audit = spark.createDataFrame(SAMPLE, "k string, v double"), AuditAgent("other"), AuditAgent("t")
    frame = private(spark, SAMPLE, agent=audit)
    frame.concat(public).noisy_count(1.0)
    frame.left_join_list(public, "k", "k", [F.count("v").alias("n")]).noisy_count(1.0)
    assert audit.total == 2.0
    frame.join(public, "k", "k", 2, 3, [F.col("l.k")], "v", "v", agent=other).noisy_count(1.0)
    assert (audit.total, other.total) == (8.0, 4.0)
    with pytest.raises(TypeError):
        frame.concat([1])


def test_order_statistics_charge_by_their_fraction(spark):
    for compat, want in ((False, 2 * 0.9 * 0.5), (True, 0.5)):
        audit = AuditAgent("t")
        private(spark, SAMPLE, agent=audit, compat=compat).noisy_order_statistic(0.5, 0.9, F.col("v"))
        assert audit.total == pytest.approx(want)


STABLE = [c for c in CHARGES if c[0] not in ("concat", "union", "intersect", "except", "join_groups", "join", "left_join_groups")]


@pytest.mark.parametrize("name, op, factor", STABLE, ids=[c[0] for c in STABLE])
def test_stability(spark, name, op, factor):
    """Adding one record changes at most as many rows as the charge says."""
    rng = random.Random(name)
    for _ in range(3):
        rows = [(rng.choice("abc"), float(rng.randint(0, 4))) for _ in range(rng.randint(0, 8))]
        more = rows + [(rng.choice("abc"), float(rng.randint(0, 4)))]
        one, two = (Counter(map(repr, values(op(private(spark, r))))) for r in (rows, more))
        changed = sum(((one - two) + (two - one)).values())
        assert changed <= factor


def test_join_bounds_and_null_keys(spark):
    left = private(spark, [("a", 1.0), ("a", 2.0), ("a", 3.0), (None, 9.0)])
    right = private(spark, [("a", 7.0), ("a", 8.0), (None, 9.0)])
    joined = left.join(right, "k", "k", 2, 1, [F.col("l.v").alias("x"), F.col("r.v").alias("y")], "v", "-v")
    assert values(joined) == [(1.0, 8.0), (2.0, 8.0)]
    listed = left.left_join_list(reveal(right), "k", "k", [F.collect_list("v").alias("vs")], {"vs": F.array().cast("array<double>")})
    assert sorted(len(r[2]) for r in values(listed)) == [0, 2, 2, 2]


def test_flat_map_and_groups(spark):
    frame = private(spark, [([1, 2, 3],), ([],), (None,), ([4],)], "xs array<int>")
    assert values(frame.flat_map(2, F.col("xs"))) == [(1,), (2,), (4,)]
    items = private(spark, SAMPLE).group_by("k").items("v")
    assert sorted((r[0] or "", len(r[1])) for r in values(items)) == [("", 1), ("a", 3), ("b", 2)]


def test_partition(spark):
    audit = AuditAgent("t")
    parts = private(spark, SAMPLE, agent=audit).partition(["a", "z", "a", None], "k")
    assert list(parts) == ["a", "z", None] and len(parts) == 3
    counts = parts.noisy_counts(1.0)
    assert {k: round(v - LN2) for k, v in counts.items()} == {"a": 3, "z": 0, None: 1}
    assert audit.total == 1.0
    assert parts["a"].noisy_count(0.5) == pytest.approx(3 + 2 * LN2) and audit.total == 1.5
    assert parts["z"].noisy_count(0.5) == pytest.approx(2 * LN2) and audit.total == 1.5
    with pytest.raises(KeyError):
        parts["b"]
    inner = parts["a"].partition([1.0, 2.0], "v").noisy_counts(1.0)
    assert {k: round(v - LN2) for k, v in inner.items()} == {1.0: 2, 2.0: 1}


def test_partition_refusal_gives_everything_back(spark):
    budget = BudgetAgent(1.0)
    parts = private(spark, SAMPLE, agent=budget).partition(["a", "b"], "k")
    with pytest.raises(PrivacyDenied):
        parts.noisy_counts(2.0)
    assert budget.remaining == 1.0 and all(v == 0 for v in parts._ledger.spent.values())


@pytest.mark.parametrize("order", ["v", "-v", ["k", "-v"]])
@pytest.mark.parametrize("n", [0, 1, 3, 6, 50])
def test_take_and_skip_split_the_rows(spark, n, order):
    frame = private(spark, SAMPLE + [("a", 1.0)])
    both = Counter(map(repr, values(frame.take(n, order)))) + Counter(map(repr, values(frame.skip(n, order))))
    assert both == Counter(map(repr, values(frame)))
    assert len(values(frame.take(n, order))) == min(n, 7)
    assert skip_rows(reveal(frame), -1, "v").count() == 7


REJECTED = [
    ("aggregate", lambda f: f.select(F.count("v"))),
    ("window", lambda f: f.select(F.row_number().over(__import__("pyspark").sql.Window.orderBy("v")))),
    ("window in filter", lambda f: f.where(F.row_number().over(__import__("pyspark").sql.Window.orderBy("v")) > 1)),
    ("generator", lambda f: f.select(F.explode(F.array("v")))),
    ("random", lambda f: f.select(F.rand())),
    ("python", lambda f: f.select(F.udf(lambda x: x, "double")("v"))),
    ("subquery", lambda f: f.select(F.expr("(select max(id) from range(3))"))),
    ("window in aggregate", lambda f: f.group_by("k").agg(F.sum(F.udf(lambda x: x, "double")("v")))),
]


@pytest.mark.parametrize("name, op", REJECTED, ids=[r[0] for r in REJECTED])
def test_guard_rejects(spark, name, op):
    with pytest.raises(GuardError):
        op(private(spark, SAMPLE))


def test_guard_can_allow_python(spark):
    frame = private(spark, SAMPLE, guard=Guard(allow_python=True))
    assert len(values(frame.select(F.udf(lambda x: 1.0, "double")("v").alias("x")))) == 6


def test_subclasses_stay_themselves(spark):
    class Mine(PrivateFrame):
        pass

    frame = Mine(spark.createDataFrame(SAMPLE, "k string, v double"))
    assert type(frame.where("v > 0").materialize()) is Mine and type(frame.as_base()) is PrivateFrame
    assert frame.schema.names == ["k", "v"]


def test_failures_are_opaque_and_stay_charged(spark):
    from veilframe.operators.release import ReleaseFailed

    audit = AuditAgent("t")
    frame = private(spark, [("x", 1.0)], agent=audit).where(F.col("k").cast("int") > 0)
    with pytest.raises(ReleaseFailed) as error:
        frame.noisy_count(1.0)
    assert "x" not in str(error.value).replace("the release", "") or "CAST" not in str(error.value)
    assert audit.total == 1.0
