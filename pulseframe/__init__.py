"""Service-health metric inspection as composable Spark DataFrame operators."""

from pulseframe.policy import Policy, default_policy
from pulseframe.plans.inspect import inspect

__all__ = ["Policy", "default_policy", "inspect"]
