"""Vectors of texts without a model: words and pairs of neighbours, hashed to signed places."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lodestone.functions import text


#: Codes of features that a task remembers.
REMEMBERED = 200_000


def code(feature: str, size: int) -> int:
    """Twice the place of a feature, and one more where it counts negatively: both by its MD5."""
    digest = hashlib.md5(feature.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
    return int.from_bytes(digest[:4], "big") % size * 2 + (digest[4] >> 4 & 1)


def text_vectors(df: DataFrame, content: Column, size: int = 256, clip: int | None = None) -> DataFrame:
    """``df`` with vector, an array of ``size`` doubles of length one; all zeros for a text without words, and for null.

    Features are the lower-case words and the pairs of neighbouring ones, repeats included.
    Words come out of built-in functions; tasks hash each feature once, as far as they
    remember it, and add up text by text. ``clip`` cuts texts to so many characters, as
    services with a limit do; whole texts are taken without it.
    """
    known: dict[str, int] = {}

    @pandas_udf("array<double>")
    def added(said: pd.Series) -> pd.Series:
        out = []
        for words in said.str.split(" "):
            words = words if words != [""] else []
            found = [*words, *map(" ".join, zip(words, words[1:], strict=False))]
            if len(known) > REMEMBERED:
                known.clear()
            row = np.empty(len(found), np.int64)
            for i, x in enumerate(found):
                c = known.get(x)
                if c is None:
                    c = known[x] = code(x, size)
                row[i] = c
            total = np.bincount(row >> 1, 1.0 - 2.0 * (row & 1), size)
            norm = np.sqrt(total @ total)
            out.append(total / norm if norm > 0 else total)
        return pd.Series(out, dtype=object)

    if clip is not None:
        content = F.substring(content, 1, clip)
    # said to be nondeterministic, so that Spark doesn't work the vectors out again for each use of them
    return df.withColumn("vector", added.asNondeterministic()(F.array_join(text.words(F.lower(F.coalesce(content, F.lit("")))), " ")))
