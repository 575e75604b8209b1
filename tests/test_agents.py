"""The accounting agents against a naive model, without Spark."""

import random
import threading

import pytest

from veilframe import Agent, AuditAgent, BudgetAgent, PairAgent, PartitionAgent, ScaledAgent
from veilframe.plans.agents import PartitionLedger, check_bound, check_epsilon


def test_budget_allows_its_last_bit_and_refunds():
    budget = BudgetAgent(1.0)
    assert budget.apply(1.0) and not budget.apply(1e-9)
    assert budget.apply(-0.5) and budget.remaining == 0.5


def test_nan_never_spends():
    budget = BudgetAgent(1.0)
    with pytest.raises(ValueError):
        budget.apply(float("nan"))
    assert budget.remaining == 1.0


@pytest.mark.parametrize("eps", [float("nan"), -1, 0, float("inf"), float("-inf")])
def test_epsilon_is_finite_and_positive(eps):
    with pytest.raises(ValueError):
        check_epsilon(eps)


@pytest.mark.parametrize("k", [-1, 0, 1.5, True, None])
def test_bounds_are_positive_integers(k):
    with pytest.raises(ValueError):
        check_bound(k)


def test_scaled_and_pair_roll_back():
    a, b = BudgetAgent(10.0), BudgetAgent(1.0)
    pair = PairAgent(ScaledAgent(a, 2), b)
    assert pair.apply(1.0) and (a.remaining, b.remaining) == (8.0, 0.0)
    assert not pair.apply(0.5) and (a.remaining, b.remaining) == (8.0, 0.0)


def test_self_pair_costs_twice():
    budget = BudgetAgent(1.0)
    assert PairAgent(budget, budget).apply(0.5) and budget.remaining == 0.0
    assert not PairAgent(budget, budget).apply(0.1)


def test_partition_charges_the_dearest_part():
    budget = BudgetAgent(10.0)
    ledger = PartitionLedger(budget, "abc")
    parts = {k: PartitionAgent(ledger, k) for k in "abc"}
    assert parts["a"].apply(2.0) and budget.remaining == 8.0
    assert parts["b"].apply(1.5) and budget.remaining == 8.0
    assert parts["b"].apply(1.0) and budget.remaining == 7.5
    assert parts["b"].apply(-1.0) and budget.remaining == 8.0
    assert not parts["c"].apply(11.0) and ledger.spent["c"] == 0.0


def test_partition_against_a_naive_model():
    rng = random.Random(7)
    for _ in range(200):
        budget = BudgetAgent(5.0)
        ledger = PartitionLedger(budget, range(3))
        spent = [0.0] * 3
        for _ in range(20):
            k, eps = rng.randrange(3), rng.choice([0.25, 0.5, 1.0, -0.25])
            trial = spent.copy()
            trial[k] += eps
            fits = max(trial) <= 5.0
            assert PartitionAgent(ledger, k).apply(eps) == fits
            spent = trial if fits else spent
            assert budget.remaining == pytest.approx(5.0 - max(spent))


def test_nested_partitions():
    budget = BudgetAgent(10.0)
    outer = PartitionLedger(budget, "xy")
    inner = {k: PartitionLedger(PartitionAgent(outer, k), "pq") for k in "xy"}
    for k in "xy":
        for j in "pq":
            assert PartitionAgent(inner[k], j).apply(1.0)
    assert budget.remaining == 9.0


def test_audit_keeps_a_ledger_only_of_what_was_granted():
    audit = AuditAgent("a", BudgetAgent(1.0))
    assert audit.apply(0.4) and not audit.apply(0.7) and audit.apply(0.6)
    assert audit.ledger == [(1, 0.4, 0.4), (2, 0.6, 1.0)]
    assert Agent().apply(1e9)


def test_charges_are_atomic_across_threads():
    budget, granted = BudgetAgent(100.0), []
    threads = [threading.Thread(target=lambda: granted.extend(budget.apply(1.0) for _ in range(50))) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(granted) == 100 and budget.remaining == 0.0
