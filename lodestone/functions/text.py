"""Text rules that built-in expressions can't say, over Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F, types as T


@F.pandas_udf(T.StringType())
def unicode_key(names: pd.Series) -> pd.Series:
    """Compatibility forms without combining marks, lower-case: for names of any script. Null stays null."""
    return names.map(lambda s: None if s is None else "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch)).lower())
