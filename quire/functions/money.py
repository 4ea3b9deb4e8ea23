"""Fees in exact decimals. Unknown stays unknown: null is never 0, and currencies are never added up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "decimal(38,12)"


def fee(per_request: Column, input_rate: Column, output_rate: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Per request if there is such a price, else (in * rate + out * rate) per million; null if any part is unknown."""
    part = lambda tokens, rate: tokens.cast("decimal(18,0)") * rate.cast("decimal(18,6)")
    by_tokens = ((part(tokens_in, input_rate) + part(tokens_out, output_rate)) / F.lit(1_000_000)).cast(KIND)
    return F.when(per_request.isNotNull(), per_request.cast(KIND)).otherwise(by_tokens)


def saturating_add(a: Column, b: Column) -> Column:
    """Longs that stop at the largest or the smallest one instead of overflowing."""
    end = F.when(a > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63 - 1)) - 1)
    return F.coalesce(F.try_add(a, b), F.when(a.isNotNull() & b.isNotNull(), end))
