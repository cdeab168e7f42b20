"""Job parameters with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BarPathParams:
    """Cleaning of a bar path: least wrist visibility, largest step between frames, smoothing window and degree."""

    visibility: float = 0.5
    max_step: float = 50.0
    window: int = 7
    degree: int = 2


@dataclass(frozen=True)
class ArmParams:
    """Arm analysis: every so-manieth frame, largest elbow difference, least lockout angle, least landmark visibility."""

    every: int = 3
    symmetry: float = 15.0
    lockout: float = 160.0
    visibility: float = 0.5


@dataclass(frozen=True)
class TrainingParams:
    """Model training: up to `leave_one_out` lifts each is a fold of its own, beyond that `folds` stratified ones."""

    leave_one_out: int = 20
    folds: int = 5
    seed: int = 42
    trees: int = 100
    forest_depth: int = 3
    boosted_depth: int = 2
    #: Fits that run side by side.
    parallel: int = 4
