"""Shannon entropy of long texts (B11 over whole documents).

``functions.names.entropy`` folds over the distinct characters of one
string and rescans the string for each of them: right for domain names
(tens of characters), quadratic-ish for documents of 100,000 characters.
A document's entropy depends on its own row only,

    H = log2(n) - (1/n) * sum_c count_c * log2(count_c),

so long texts go through one vectorised Arrow function that counts code
points with numpy: no shuffle, one pass, memory of one batch of texts.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(points) if points.max() < 0x3000 else np.unique(points, return_counts=True)[1]
    counts = counts[counts > 0].astype(float)
    return float(np.log2(len(points)) - (counts * np.log2(counts)).sum() / len(points))


def entropy_of_texts():
    """A function of a text column: entropy in bits per code point."""
    @F.pandas_udf("double")
    def entropy(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _entropy(t) for t in texts], dtype="float64")

    return entropy


def text_entropy(df: DataFrame, key: str, col: str, out: str = "entropy") -> DataFrame:
    """(key, entropy) for every row of ``df``; empty text -> 0.0, null -> null."""
    return df.select(key, entropy_of_texts()(F.col(col)).alias(out))
