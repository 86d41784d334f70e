"""Classification of provider errors and the retry schedule, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions import fixed_values as fv


def error_status(provider: Column, message: Column, status: Column) -> Column:
    """Status given by the provider, else the first known code named in the message."""
    named = F.coalesce(
        *[F.when(message.contains(str(code)), code) for code in fv.STATUS_SEARCH_ORDER]
    )
    return F.when(provider == "gemini", F.coalesce(status, named))


def is_daily_quota(message: Column, status: Column) -> Column:
    per_day = message.contains("PerDay") | F.lower(message).contains("per day")
    return F.coalesce((status == fv.RATE_LIMIT_STATUS) & per_day, F.lit(False))


def is_retryable(status: Column) -> Column:
    return F.coalesce(status.isin(*fv.RETRYABLE_STATUS), F.lit(False))


def is_server_error(status: Column) -> Column:
    return F.coalesce(status.between(500, 599), F.lit(False))


def classify_error(provider: Column, message: Column, status: Column) -> Column:
    """Struct ``<message, status_code, retryable, provider>``; other providers never retry."""
    code = error_status(provider, message, status)
    return F.struct(
        message.alias("message"),
        code.alias("status_code"),
        (is_retryable(code) & ~is_daily_quota(message, code)).alias("retryable"),
        provider.alias("provider"),
    )


def retry_delay(status: Column, attempt: Column) -> Column:
    """Seconds to wait after a failed attempt (1-based)."""
    limited = F.lit(fv.RATE_LIMIT_DELAY) * attempt
    backoff = F.lit(fv.BASE_DELAY) * F.pow(F.lit(2.0), attempt - 1)
    wanted = F.when(status == fv.RATE_LIMIT_STATUS, limited).otherwise(backoff)
    return F.least(wanted, F.lit(fv.MAX_DELAY))
