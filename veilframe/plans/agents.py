"""Privacy accounting.

Agents form a tree. A release asks the agent of its frame for an amount of
privacy loss; the request climbs towards the budgets at the roots, scaled and
split on the way. A negative amount is a refund and is always accepted. One
lock covers every tree, so that check and charge are atomic across threads.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Hashable, Iterable

_LOCK = threading.RLock()


class PrivacyDenied(RuntimeError):
    """A budget refused the charge; no data was read."""


def check_epsilon(eps: float) -> float:
    """A release needs a finite, positive epsilon: zero gives infinite noise, infinity none."""
    value = float(eps)
    if not math.isfinite(value) or value <= 0:
        raise ValueError("epsilon must be finite and greater than zero")
    return value


def check_bound(k: int) -> int:
    """A row bound scales the charge, so it has to be an integer of at least one."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("a bound must be an integer of at least 1")
    return k


class Agent:
    """Accepts everything; the base of all agents."""

    def apply(self, eps: float) -> bool:
        """Charge ``eps``; True if it was accepted."""
        if math.isnan(eps):
            raise ValueError("epsilon is NaN")
        with _LOCK:
            return self._charge(float(eps))

    def _charge(self, eps: float) -> bool:
        return True


class BudgetAgent(Agent):
    """Accepts charges until the budget is spent to the last bit."""

    def __init__(self, budget: float):
        if math.isnan(budget) or budget < 0:
            raise ValueError("a budget must be a number of at least 0")
        self.remaining = float(budget)

    def _charge(self, eps: float) -> bool:
        if eps > self.remaining:
            return False
        self.remaining -= eps
        return True


class ScaledAgent(Agent):
    """Multiplies each charge by the stability constant of a transformation."""

    def __init__(self, target: Agent, scale: float):
        if not math.isfinite(scale) or scale <= 0:
            raise ValueError("a scale must be finite and greater than zero")
        self.target, self.scale = target, float(scale)

    def _charge(self, eps: float) -> bool:
        return self.target._charge(eps * self.scale)


class PairAgent(Agent):
    """Charges two agents or neither."""

    def __init__(self, first: Agent, second: Agent):
        self.first, self.second = first, second

    def _charge(self, eps: float) -> bool:
        if not self.first._charge(eps):
            return False
        if self.second._charge(eps):
            return True
        self.first._charge(-eps)
        return False


class PartitionLedger:
    """What each part of one partition has spent; the target has paid the largest of these."""

    def __init__(self, target: Agent, keys: Iterable[Hashable]):
        self.target = target
        self.spent = dict.fromkeys(keys, 0.0)
        self.paid = 0.0

    def settle(self, key: Hashable, eps: float) -> bool:
        """Charge one part. What was paid is the largest amount spent, so only a refund has to look at all parts."""
        before = self.spent[key]
        self.spent[key] = before + eps
        if self._pay(max(self.paid, before + eps) if eps >= 0 else max(self.spent.values())):
            return True
        self.spent[key] = before
        return False

    def settle_all(self, eps: float) -> bool:
        """Charge every part the same, all or none, with one request to the target."""
        with _LOCK:
            if not self.spent:
                return True
            if not self._pay(max(self.spent.values()) + eps):
                return False
            for key in self.spent:
                self.spent[key] += eps
            return True

    def _pay(self, owed: float) -> bool:
        change = owed - self.paid
        if change != 0 and not self.target._charge(change):
            return False
        self.paid = owed
        return True


class PartitionAgent(Agent):
    """Parallel composition: disjoint parts together cost as much as the dearest of them."""

    def __init__(self, ledger: PartitionLedger, key: Hashable):
        self.ledger, self.key = ledger, key

    def _charge(self, eps: float) -> bool:
        return self.ledger.settle(self.key, eps)


class AuditAgent(Agent):
    """Keeps a ledger of (step, delta, total) and passes charges on to ``target`` if there is one."""

    def __init__(self, name: str, target: Agent | None = None, echo: bool = False):
        self.name, self.target, self.echo = name, target, echo
        self.total = 0.0
        self.ledger: list[tuple[int, float, float]] = []

    def _charge(self, eps: float) -> bool:
        if self.target is not None and not self.target._charge(eps):
            return False
        self.total += eps
        self.ledger.append((len(self.ledger) + 1, eps, self.total))
        if self.echo:
            print(f"{self.name}: charged {eps:g}, {self.total:g} in all")
        return True
