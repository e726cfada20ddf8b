"""Text functions, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_space(text: Column) -> Column:
    """Runs of ASCII white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fingerprint(text: Column) -> Column:
    """A hash of the lower-cased text with its white space normalized."""
    return F.md5(normalize_space(F.lower(text)))
