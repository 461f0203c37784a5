"""One small factorisation for each value of a key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skinnyla.functions.kernels import canonical, thin_qr


def grouped_r(df: DataFrame, key: str, columns: Sequence[str], salts: int = 16) -> DataFrame:
    """(key, r): R (row-major) of each key's rows, with a diagonal that is not negative.

    A key's rows are dealt to salted parts that are factored apart and then stacked, so a key that holds
    much of the data does not meet in one task.
    """
    n = len(columns)
    kind = dict(df.dtypes)[key]

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        r = thin_qr(pdf[list(columns)].to_numpy(float))[1]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "r": [r.ravel()]})

    def stacked(pdf: pd.DataFrame) -> pd.DataFrame:
        r = canonical(thin_qr(np.vstack([np.asarray(x).reshape(n, n) for x in pdf["r"]]))[1])[1]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "r": [r.ravel()]})

    schema = f"`{key}` {kind}, r array<double>"
    rows = df.select(key, *[F.col(c).cast("double") for c in columns]).withColumn("salt", F.pmod(F.xxhash64(*columns), F.lit(salts)))
    return rows.groupBy(key, "salt").applyInPandas(local, schema).groupBy(key).applyInPandas(stacked, schema)
