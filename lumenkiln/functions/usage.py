"""Provider responses: text, token usage, cost."""

from __future__ import annotations

from decimal import ROUND_CEILING, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token bounds of one request, and the default prices in USD a million tokens (input, cached input, output).
MAX_INPUT, MAX_OUTPUT = 2_560, 100
PRICES = (Decimal("2"), Decimal("0.2"), Decimal("12"))
RESPONSE = "output_text string, output array<struct<content:array<struct<text:string>>>>"


def cost_usd(tokens_in: Column, cached: Column, tokens_out: Column, prices: tuple[Decimal, Decimal, Decimal] = PRICES) -> Column:
    """Cost to the micro-dollar, rounded up; null if the counts can't be right."""
    money = lambda c, r: c.cast("decimal(12,0)") * F.lit(r).cast("decimal(12,6)")
    total = (money(tokens_in - cached, prices[0]) + money(cached, prices[1]) + money(tokens_out, prices[2])) / F.lit(Decimal(1_000_000))
    valid = (cached <= tokens_in) & (tokens_in <= MAX_INPUT) & (tokens_out <= MAX_OUTPUT) & (cached >= 0) & (tokens_out >= 0)
    return F.when(valid, F.ceil(total, F.lit(6)).cast("decimal(20,6)"))


def max_request_cost(prices: tuple[Decimal, Decimal, Decimal] = PRICES) -> Decimal:
    total = (MAX_INPUT * max(prices[0], prices[1]) + MAX_OUTPUT * prices[2]) / Decimal(1_000_000)
    return total.quantize(Decimal("0.000001"), rounding=ROUND_CEILING)


def response_text(body: Column) -> Column:
    """output_text, else the first non-blank text of the output's contents."""
    r = F.from_json(body, RESPONSE)
    texts = F.filter(F.flatten(F.transform(r["output"], lambda o: F.transform(o["content"], lambda c: c["text"]))), lambda t: F.trim(t) != "")
    return F.coalesce(F.nullif(F.trim(r["output_text"]), F.lit("")), F.trim(F.get(texts, F.lit(0))))


def usage_count(body: Column, *paths: str) -> Column:
    """The first of the JSON paths that holds a whole number from 0 to 10 million; booleans and texts don't count."""
    found = []
    for path in paths:
        raw = F.get_json_object(body, path)
        found.append(F.when(raw.rlike(r"^\d{1,8}$") & (raw.try_cast("long") <= 10_000_000), raw.try_cast("long")))
    return F.coalesce(*found)
