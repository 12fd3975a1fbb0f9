"""Selections in which ``None`` stands for everything and the empty set for nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def selected(column: Column, selection: set[str] | None) -> Column:
    """Whether a value is chosen."""
    if selection is None:
        return F.lit(True)
    return column.isin(*sorted(selection)) if selection else F.lit(False)


def toggle(selection: set[str] | None, value: str, known: list[str]) -> set[str] | None:
    """Choose a value, or drop it if it was chosen; all values together are everything again."""
    changed = set(known if selection is None else selection) ^ {value}
    return None if len(changed) == len(known) else changed


def selection_summary(plural: str, selection: set[str] | None, total: int) -> str:
    """``no models``, ``all 5 models`` or ``2 of 5 models``."""
    if not total:
        return f"no {plural}"
    chosen = "all" if selection is None else f"{len(selection)} of"
    return f"{chosen} {total} {plural}"
