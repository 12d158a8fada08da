"""Samples of groups: bounded, first k, and most different by cosine distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine_distance(a: str, b: str) -> Column:
    """1 - dot product of two arrays of unit length, in double precision."""
    return 1 - F.aggregate(F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def bounded(rows: DataFrame, keys: list[str], order: list[str], most: int = 50, seed: int = 0) -> DataFrame:
    """At most `most` rows of each group, in an order that a hash shuffles and reruns repeat."""
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(*order, F.lit(seed)), *order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def spread(vectors: np.ndarray, least: int = 5, most: int = 20, stop: float = 0.2) -> list[int]:
    """Farthest-point choice: from the first on, always the one whose nearest chosen is farthest
    (the last of equals); ends at `most`, or below `stop` once there are `least`."""
    n = len(vectors)
    if n < least:
        return list(range(n))
    chosen, near = [0], 1 - vectors @ vectors[0]
    while len(chosen) < min(most, n):
        left = near.copy()
        left[chosen] = -np.inf
        i = int(n - 1 - np.argmax(left[::-1]))
        if left[i] < stop and len(chosen) >= least:
            break
        chosen.append(i)
        near = np.minimum(near, 1 - vectors @ vectors[i])
    return chosen


def most_different(rows: DataFrame, key: str, id_col: str, vector: str, pre: int = 50) -> DataFrame:
    """(key, id, rank): per group the most different rows of a bounded sample of it."""
    few = bounded(rows, [key], [id_col], pre).select(key, id_col, F.col(vector).cast("array<double>").alias("v"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(id_col)
        at = spread(np.stack(f["v"].to_list()))
        return pd.DataFrame({key: f[key].iloc[at].to_numpy(), id_col: f[id_col].iloc[at].to_numpy(), "rank": range(len(at))})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return few.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, rank long")
