"""Small string helpers: memory figures, file extensions, word splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII white space only, so that every SQL engine splits alike.
_SPACE = r"[ \t\n\x0B\f\r]+"


def format_memory(size: Column) -> Column:
    """``1.5 GB`` from 1 GiB on, ``512 MB`` below."""
    mib = size / F.lit(1024.0 * 1024.0)
    return F.when(mib >= 1024, F.format_string("%.1f GB", mib / 1024.0)).otherwise(F.format_string("%.0f MB", mib))


def path_extension(path: Column) -> Column:
    """From the last dot after the last slash on; empty when there is none."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def words(text: Column) -> Column:
    """Lower-case words; the first and last entry may be empty."""
    return F.split(F.lower(text), _SPACE)
