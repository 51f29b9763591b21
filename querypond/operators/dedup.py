"""Duplicates by content and by address, and greedy semantic ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normal_text(text) -> F.Column:
    return F.regexp_replace(F.lower(F.trim(text)), "[ \\t\\r\\n]+", " ")


def first_by(df: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key; the rank limit is applied before the shuffle, too."""
    return df.withColumn("_first_by", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_first_by = 1").drop("_first_by")


def exact(df: DataFrame, text: str, order: str) -> DataFrame:
    return first_by(df.withColumn("content_hash", F.sha2(normal_text(F.col(text)), 256)), [F.col("content_hash")], [F.col(order)])


def greedy(df: DataFrame, *, group: str, position: str, vector: str, threshold: float = 0.93) -> DataFrame:
    """Rows that are kept when, in order, each kept row drops the later ones of its group within the similarity.

    Groups are result lists (tens to hundreds of rows); a longer list is handled in one pass over the kept rows only.
    """
    rest = [c for c in df.columns if c != vector]

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position)
        kept: list[int] = []
        vectors = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vector]])
        norms = np.linalg.norm(vectors, axis=1)
        units = vectors / np.where(norms == 0, 1, norms)[:, None]
        for i in range(len(units)):
            if not kept or (units[kept] @ units[i]).max() < threshold:
                kept.append(i)
        return pdf.iloc[kept][rest]

    return df.groupBy(group).applyInPandas(keep, df.select(*rest).schema)


