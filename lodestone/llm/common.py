"""Shared-folder tables and small helpers used by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.shared import materialise, new_path, release, shared_folder, spread  # noqa: F401

#: A word: a run of anything but the six ASCII white-space characters (fixed value).
SPACE = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Array of the words of ``text``; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")
