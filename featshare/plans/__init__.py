"""Composed plans and the registry of named queries with their SQL oracles."""

from featshare.plans.source_plan import source_plan, source_run_summary
from featshare.plans.target_plan import deployment_decision, target_plan

__all__ = ["source_plan", "source_run_summary", "deployment_decision", "target_plan"]
