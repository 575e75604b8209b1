"""veilframe: private analytics on Spark DataFrames.

A :class:`PrivateFrame` wraps a DataFrame whose rows can be transformed freely
but leave only through noisy releases, each paid for from a privacy budget.
"""

from veilframe.operators.frame import PrivateFrame
from veilframe.operators.groups import PrivateGroups
from veilframe.operators.partitions import PrivatePartitions
from veilframe.plans.agents import (
    Agent,
    AuditAgent,
    BudgetAgent,
    PairAgent,
    PartitionAgent,
    PrivacyDenied,
    ScaledAgent,
)
from veilframe.plans.guard import Guard, GuardError
from veilframe.plans.noise import NoiseSource

__all__ = [
    "Agent",
    "AuditAgent",
    "BudgetAgent",
    "Guard",
    "GuardError",
    "NoiseSource",
    "PairAgent",
    "PartitionAgent",
    "PrivacyDenied",
    "PrivateFrame",
    "PrivateGroups",
    "PrivatePartitions",
    "ScaledAgent",
]
