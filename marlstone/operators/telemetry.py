"""Cost of model calls from a price table, and its roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = ("prompt_tokens", "cached_input_tokens", "candidate_tokens", "reasoning_tokens", "total_tokens")


def cost(calls: DataFrame, prices: DataFrame, digits: int = 8) -> DataFrame:
    """Adds ``estimated_cost_usd``, null where the model has no price.

    ``prices(model, input, cached_input, output)`` in USD for a million tokens: a short list, left to the optimiser to broadcast.
    """
    n = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    fresh = F.greatest(n("prompt_tokens") - n("cached_input_tokens"), F.lit(0))
    out = n("candidate_tokens") + n("reasoning_tokens")
    usd = (fresh * F.col("input") + n("cached_input_tokens") * F.col("cached_input") + out * F.col("output")) / F.lit(1e6)
    return calls.join(prices, "model", "left").withColumn("estimated_cost_usd", F.round(usd, digits)).drop("input", "cached_input", "output")


def usage(calls: DataFrame, *by: Column | str) -> DataFrame:
    """Sums by group; the total cost is null if any call has no price, whose models are listed."""
    known = F.round(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)), 8)
    return calls.groupBy(*by).agg(
        F.count("*").alias("call_count"), *[F.sum(c).alias(c) for c in TOKENS], F.when(F.count_if(F.col("estimated_cost_usd").isNull()) == 0, known).alias("estimated_cost_usd"),
        known.alias("known_estimated_cost_usd"), F.array_sort(F.collect_set(F.when(F.col("estimated_cost_usd").isNull(), F.col("model")))).alias("unpriced_models"),
    )


class CostGuard:
    """Cap on spent USD, checked before and after each call."""

    def __init__(self, most_usd: float):
        if most_usd <= 0:
            raise ValueError("the cost cap must be positive")
        self.most_usd, self.spent = most_usd, 0.0

    def check(self) -> None:
        if self.spent >= self.most_usd:
            raise RuntimeError(f"cost cap reached: {self.spent:.6f} of {self.most_usd:.6f} USD")

    def add(self, usd: float | None) -> None:
        self.spent += usd or 0.0
