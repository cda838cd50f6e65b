"""A built-in vector for a text, where no model is at hand.

Any function of a Column to an array of floats can take its place in a search.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.match import tokens

DIMENSIONS = 64


def hashed_vector(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Counts of a text's distinct tokens by hashed place, of length 1; ``[]`` for texts without tokens, null for null."""
    places = F.transform(tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int") % dimensions)
    # the counts are computed once, in an array of one, for vector and length
    counts = F.transform(F.array(places), lambda ps: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(ps, lambda p: p == i)).cast("double")))
    unit = F.transform(counts, lambda v: F.transform(v, lambda x: (x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y))).cast("float")))[0]
    return F.when(F.size(places) > 0, unit).when(text.isNotNull(), F.array().cast("array<float>"))
