"""Search parameters and scores."""

from pyspark.sql import Column, functions as F

from snipquarry import settings


def clamp_k(k: Column, limit=settings.MAX_K) -> Column:
    """`k` between 1 and `limit`; NULL means the default."""
    return F.least(F.greatest(F.coalesce(k, F.lit(settings.DEFAULT_K)), F.lit(1)), F.lit(limit)).cast("int")


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)
