"""The best fragment of a text: the first window of a hundred characters with the most matched terms, with marks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 100
BEFORE, AFTER = '<span class="hl">', "</span>"


def _pattern(words: list[str]) -> str:
    return "(?i)(^|[^\\p{L}\\p{N}])(" + "|".join(map(re.escape, words)) + ")([^\\p{L}\\p{N}]|$)"


def best_fragment(text: Column, words: list[str], window: int = WINDOW) -> Column:
    """Blanks are doubled while terms are looked for, so that neighbours don't share the one between them."""
    if not words:
        return F.substring(text, 1, window)
    pattern = F.lit(_pattern(words))
    wide = lambda x: F.replace(x, F.lit(" "), F.lit("  "))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / window) - 1, F.lit(0)).cast("int"))
    rated = F.transform(starts, lambda k: F.struct(F.size(F.regexp_extract_all(wide(F.substring(text, k * window + 1, F.lit(window))), pattern, F.lit(2))).alias("n"), (-k).alias("first")))
    best = F.array_max(rated)
    fragment = F.substring(text, -best["first"] * window + 1, F.lit(window))
    return F.replace(F.regexp_replace(wide(fragment), pattern, F.lit(f"$1{BEFORE}$2{AFTER}$3")), F.lit("  "), F.lit(" "))
