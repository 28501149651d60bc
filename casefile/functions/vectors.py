"""Vector columns: norms, cosine, and the binary form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(c: Column) -> Column:
    """The vector over its length, in double precision; a zero vector stays."""
    return F.transform(c, lambda x: x.cast("double") / F.when(_norm(c) == 0, F.lit(1.0)).otherwise(_norm(c)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Inner product over both lengths, a zero length counting as 1."""
    length = lambda c: F.when(_norm(c) == 0, F.lit(1.0)).otherwise(_norm(c))
    return dot(a, b) / (length(a) * length(b))


@F.pandas_udf(T.BinaryType())
def encode_vector(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats; null stays null."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))
