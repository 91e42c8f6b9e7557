"""Scoring models by name: how often, how rare and how long become a leaf's part of a score."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Similarity:
    idf: Callable[[int, int], float]  # documents, documents with the term
    tf: Callable[[Column], Column]
    norm: Callable[[Column], Column]  # of the number of tokens
    coord: bool = True  # the share of leaves that match is a factor


#: sqrt(tf) * idf^2 / sqrt(length), with idf = 1 + ln(N / (df + 1)).
CLASSIC = Similarity(lambda n, df: 1 + math.log(max(n, 1) / (df + 1)), lambda tf: F.sqrt(tf.cast("double")), lambda length: 1 / F.sqrt(length.cast("double")))
#: A match counts, however often.
BINARY = Similarity(CLASSIC.idf, lambda tf: F.when(tf > 0, 1.0).otherwise(0.0), lambda length: F.lit(1.0))
#: Frequencies and lengths don't matter, nor does how many leaves match.
CONSTANT = Similarity(lambda n, df: 1.0, lambda tf: F.when(tf > 0, 1.0).otherwise(0.0), lambda length: F.lit(1.0), coord=False)

SIMILARITIES = {"classic": CLASSIC, "binary": BINARY, "constant": CONSTANT}
