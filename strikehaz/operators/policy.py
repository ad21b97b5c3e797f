"""Leakage guards: preconditions on column lists, checked while a feature plan is being built."""

from __future__ import annotations

from collections.abc import Iterable

from strikehaz import fixed_values as fv
from strikehaz.schemas import STRIKES

MODES = {
    "operational_core": [*fv.RAW_PREFLIGHT, *fv.RAW_ENCOUNTER],
    "reduced_preflight": fv.RAW_PREFLIGHT,
}


class LeakageError(ValueError):
    """An outcome-describing column was about to become a model input."""


def assert_no_leakage(columns: Iterable[str], extra_forbidden: Iterable[str] = ()) -> None:
    """Deny-list guard; the error names every offender."""
    offenders = sorted(set(columns) & {*fv.OUTCOME_FIELDS, *extra_forbidden})
    if offenders:
        raise LeakageError(f"Outcome-describing columns among the model inputs: {offenders}")


def assert_mode_inputs(columns: Iterable[str], mode: str) -> None:
    """Deny-list first, then the mode's allow-list; control columns pass."""
    if mode not in MODES:
        raise ValueError(f"Unknown feature mode '{mode}'; expected one of {sorted(MODES)}")
    asked = set(columns)
    forbidden = sorted(asked & set(fv.RAW_FORBIDDEN))
    if forbidden:
        raise LeakageError(f"Outcome or administrative columns among the model inputs: {forbidden}")
    outside = sorted(asked - set(MODES[mode]) - set(fv.RAW_CONTROL))
    if outside:
        raise LeakageError(f"Columns not allowed in mode '{mode}': {outside}")


def allowed_feature_columns(columns: Iterable[str]) -> list[str]:
    """Schema fields that may be model inputs and are present, in schema order."""
    present = set(columns)
    barred = {*fv.OUTCOME_FIELDS, *fv.IDENTIFIER_FIELDS}
    return [f for f in STRIKES.names if f in present and f not in barred]
