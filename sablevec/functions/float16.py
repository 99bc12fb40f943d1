"""Half-precision values: two bytes in a table, floats in a plan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def to_half(v: pd.Series) -> pd.Series:
    """Nearest half-precision value, little-endian; beyond its range infinity."""
    with np.errstate(over="ignore"):
        a = v.to_numpy(np.float32).astype("<f2")
    return pd.Series([None if null else x.tobytes() for x, null in zip(a, v.isna(), strict=True)])


@F.pandas_udf(T.FloatType())
def from_half(b: pd.Series) -> pd.Series:
    """Null stays null."""
    a = np.frombuffer(b"".join(b"\0\0" if x is None else x for x in b), "<f2").astype(float)
    return pd.Series([None if x is None else y for x, y in zip(b, a.tolist(), strict=True)], dtype=object)
