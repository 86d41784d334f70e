"""Vector expressions on ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.charclass import let


def l2_norm(vec: Column) -> Column:
    return F.sqrt(
        F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def l2_normalize(vec: Column) -> Column:
    """Unit-length vector in double precision; a zero vector stays as it is."""
    return let(
        l2_norm(vec),
        lambda n: F.transform(
            vec, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)
        ),
    )
