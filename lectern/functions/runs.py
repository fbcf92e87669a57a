"""The longest run of characters that two texts share, and whether an answer option can be traced to its source by it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from lectern.functions.text import option_key

#: How long a shared run must be that holds a wide character, and one that holds none.
WIDE_RUN, LATIN_RUN = 2, 4
RUN = StructType().add("length", IntegerType()).add("start", IntegerType()).add("at", IntegerType())


def longest_run(a: str, b: str) -> tuple[int, int, int]:
    """(length, start in a, place in b) of the longest shared run; of equals the first in a, then its first place in b.

    A run of n holds one of n - 1, so its length is found by halving: each step compares the set of runs of one length.
    """
    lo, hi, best = 0, min(len(a), len(b)), (0, -1, -1)
    while lo < hi:
        n = (lo + hi + 1) // 2
        there = {b[i : i + n] for i in range(len(b) - n + 1)}
        start = next((i for i in range(len(a) - n + 1) if a[i : i + n] in there), None)
        if start is None:
            hi = n - 1
        else:
            lo, best = n, (n, start, b.find(a[start : start + n]))
    return best


@F.pandas_udf(RUN)
def common_run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """struct(length, start, at) of ``longest_run``; without a shared character 0, -1, -1. A null text shares nothing."""
    found = [longest_run(x or "", y or "") for x, y in zip(a, b, strict=True)]
    return pd.DataFrame(found, columns=["length", "start", "at"])


def trace_key(text: Column) -> Column:
    """What options and sources are compared by: the same as for options among themselves."""
    return option_key(F.coalesce(text, F.lit("")))


def trace(option: Column, source: Column, run: Column) -> Column:
    """within, contains, run, or null where the option can't be traced: ``run`` is ``common_run`` of the two keys."""
    need = F.when(option.rlike("[一-鿿]"), WIDE_RUN).otherwise(LATIN_RUN)
    return F.when((option == "") | (source == ""), None).when(source.contains(option), "within").when(option.contains(source), "contains").when(run["length"] >= need, "run")
