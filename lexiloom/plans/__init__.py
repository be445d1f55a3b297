"""Composed plans: chains of steps, and stages kept by the identity of their inputs."""

from lexiloom.plans.stages import StageCache, identity, run_steps

__all__ = ["StageCache", "identity", "run_steps"]
