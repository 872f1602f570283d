"""Functions that need Python: Arrow-batched, on candidate rows only."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from voxmill.functions.scalars import edit_similarity, squeezed


@pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks, 2 M / T."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)])


def similarity(pairs: DataFrame, a: str, b: str, longest: int = 5000) -> DataFrame:
    """Adds ``similarity``: by edit distance up to ``longest`` characters, by matching blocks above. Only the long pairs see Python."""
    x, y = squeezed(F.col(a)), squeezed(F.col(b))
    long = F.greatest(F.length(x), F.length(y)) > longest
    short = pairs.where(~F.coalesce(long, F.lit(False))).withColumn("similarity", edit_similarity(F.col(a), F.col(b))[1])
    return short.unionByName(pairs.where(long).withColumn("similarity", block_ratio(x, y)))
