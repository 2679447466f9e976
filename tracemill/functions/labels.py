"""Class labels from file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The class names of the two label rules.
NAMES_ANYWHERE = ("upx", "telock", "petite", "molebox", "mew", "amber", "bero", "yoda")
NAMES_AS_PREFIX = ("upx", "mew", "molebox", "telock", "petite", "amber", "yoda")
DEFAULT_LABEL = "unpacked"


def label_anywhere(name: str) -> Column:
    """First class name found anywhere in the file name."""
    found = F.regexp_extract(F.lower(F.col(name)), "(" + "|".join(NAMES_ANYWHERE) + ")", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(DEFAULT_LABEL))


def label_from_prefix(name: str) -> Column:
    """Part before the first ``-`` or ``_`` if it is a class name."""
    prefix = F.lower(F.substring_index(F.translate(F.col(name), "-", "_"), "_", 1))
    return F.when(prefix.isin(*NAMES_AS_PREFIX), prefix).otherwise(F.lit(DEFAULT_LABEL))
