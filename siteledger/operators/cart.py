"""Pricing eligibility, quantities, cart views and the fold of a mutation log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions.money import SCALE, scaled, subtotal_minor
from siteledger.functions.text import compact

MAX_QUANTITY = 10_000 * SCALE  # fixed value
MAX_LINES, MAX_OPERATIONS = 100, 512


def quantity_scaled(text: Column) -> Column:
    """Millionths of a strict quantity text; null if it is none, or not positive, or too large."""
    n = scaled(F.when(text.rlike(r"^(?:0|[1-9][0-9]{0,4})(?:\.[0-9]{1,6})?$"), text), 6)
    return F.when((n > 0) & (n <= MAX_QUANTITY), n)


def quantity_error(quantity: Column, low: Column, high: Column, step: Column) -> Column:
    """Why a scaled quantity breaks its policy, else null; unknown bounds do not bind."""
    return (
        F.when(quantity.isNull() | (quantity <= 0) | (quantity > MAX_QUANTITY), "QUANTITY_OUT_OF_RANGE")
        .when(quantity < low, "QUANTITY_BELOW_MINIMUM")
        .when(quantity > high, "QUANTITY_ABOVE_MAXIMUM")
        .when(F.pmod(quantity - F.coalesce(low, F.lit(0)), F.when(step > 0, step)) != 0, "QUANTITY_STEP_MISMATCH")
    )


def pricing_reasons(blockers: Column, candidates: Column, money_ok: Column, eligible: Column, unit: Column, low: Column, step: Column, high: Column, invalid: Column) -> Column:
    """Ordered reasons why an item has no exact price; empty if it has. candidates: how many prices have the chosen id."""
    return F.array_distinct(
        compact(
            F.when(F.size(blockers) > 0, F.lit("SOURCE_PURCHASE_BLOCKED")),
            F.when(candidates != 1, F.lit("PRICE_UNKNOWN_OR_AMBIGUOUS")),
            F.when(~F.coalesce(money_ok & eligible, F.lit(False)), F.lit("PRICE_NOT_ELIGIBLE")),
            F.when(unit.isNull() | (F.trim(unit) == "") | (F.octet_length(unit) > 80), F.lit("UNIT_UNKNOWN")),
            F.when(invalid, F.lit("QUANTITY_POLICY_INVALID")),
            F.when(low.isNull() | step.isNull(), F.lit("QUANTITY_POLICY_UNKNOWN")),
            F.when(low > high, F.lit("QUANTITY_POLICY_INVALID")),
        )
    )


def line_view(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """Cart lines with subtotal and blockers. lines: session, item_id, variant_id, quantity (scaled). prices: item_id,
    variant_id, minor, currency, unit, low, high, step, reasons."""
    p = prices.withColumnRenamed("variant_id", "_variant")
    rows = lines.join(p, (lines.item_id == p.item_id) & lines.variant_id.eqNullSafe(F.col("_variant")), "left").drop(p.item_id).drop("_variant")
    broken = F.when(F.col("minor").isNull() | quantity_error(F.col("quantity"), F.col("low"), F.col("high"), F.col("step")).isNotNull(), F.array(F.lit("SELECTION_OR_QUANTITY_NO_LONGER_VALID")))
    blockers = F.coalesce(broken, F.col("reasons"), F.array().cast("array<string>"))
    return rows.select("session", "item_id", "variant_id", "quantity", "currency", F.when(F.size(blockers) == 0, subtotal_minor(F.col("minor"), F.col("quantity"))).alias("subtotal_minor"), blockers.alias("blockers"))


def cart_view(lines: DataFrame) -> DataFrame:
    """session, lines, currencies, total_minor, pricing_status: the total is null if a line is blocked or currencies differ."""
    agg = lines.groupBy("session").agg(F.count("*").alias("lines"), F.count_if(F.size("blockers") > 0).alias("blocked"), F.count_distinct(F.when(F.size("blockers") == 0, F.col("currency"))).alias("currencies"), F.sum("subtotal_minor").alias("sum"))
    total = F.when((F.col("blocked") == 0) & (F.col("currencies") == 1), F.col("sum"))
    status = F.when(F.col("lines") == 0, "EMPTY").when(total.isNull(), "REQUIRES_CONFIRMATION").otherwise("CALCULATED_FROM_OBSERVED_FACTS")
    return agg.select("session", "lines", "currencies", total.alias("total_minor"), status.alias("pricing_status"))


STATE = "session string, line_id string, item_id string, variant_id string, quantity long"


def fold_session(rows: Iterator[tuple], cart: dict | None = None, operations: dict | None = None) -> tuple[dict, dict, list[tuple]]:
    """Apply (idempotency_key, action, item_id, variant_id, line_id, quantity, request_sha256, low, high, step) in order.

    Returns cart, operations and an outcome for each row. What breaks a rule or a cap has no effect.
    """
    cart, operations, outcomes = dict(cart or {}), dict(operations or {}), []
    for key, action, item, variant, line, quantity, digest, low, high, step in rows:
        if key in operations:
            outcomes.append((key, "REPLAYED" if operations[key] == digest else "IDEMPOTENCY_CONFLICT"))
            continue
        outcome = "APPLIED"
        if len(operations) >= MAX_OPERATIONS:
            outcome = "SESSION_OPERATION_LIMIT"
        elif action == "cart.add":
            line = f"{item}\x1f{variant or ''}"
            total = quantity + (cart[line][2] if line in cart else 0) if quantity else None
            if _broken(total, low, high, step):
                outcome = "QUANTITY_RULE"
            elif line not in cart and len(cart) >= MAX_LINES:
                outcome = "CART_LINE_LIMIT"
            else:
                cart[line] = (item, variant, total)
        elif line not in cart:
            outcome = "CART_LINE_NOT_FOUND"
        elif action == "cart.remove":
            del cart[line]
        elif _broken(quantity, low, high, step):
            outcome = "QUANTITY_RULE"
        else:
            cart[line] = (*cart[line][:2], quantity)
        if outcome == "APPLIED":
            operations[key] = digest
        outcomes.append((key, outcome))
    return cart, operations, outcomes


def _broken(quantity, low, high, step) -> bool:
    if not quantity or quantity <= 0 or quantity > MAX_QUANTITY:
        return True
    return (low is not None and quantity < low) or (high is not None and quantity > high) or bool(step and (quantity - (low or 0)) % step)


MUTATION = ["idempotency_key", "action", "item_id", "variant_id", "line_id", "quantity", "request_sha256", "low", "high", "step"]


def fold(mutations: DataFrame) -> DataFrame:
    """The carts that an ordered mutation log leaves.

    Sessions are dealt by their key and sorted on disk where memory does not do; a task reads its rows batch by batch
    and holds one session's cart and operations, which their caps bound, however long the session's log is.
    mutations: session, seq, and the columns of MUTATION (quantities scaled, policies joined on before).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, cart, operations = None, {}, {}

        def left() -> pd.DataFrame:
            return pd.DataFrame([(session, line, *v) for line, v in cart.items()], columns=["session", "line_id", "item_id", "variant_id", "quantity"])

        for pdf in batches:
            pdf = pdf.astype(object).where(lambda d: d.notna(), None)
            starts = [0, *(k for k in range(1, len(pdf)) if pdf["session"].iat[k] != pdf["session"].iat[k - 1]), len(pdf)]
            for low, high in zip(starts, starts[1:], strict=False):
                part = pdf.iloc[low:high]
                if part["session"].iat[0] != session:
                    yield left()
                    session, cart, operations = part["session"].iat[0], {}, {}
                cart, operations, _ = fold_session(part[MUTATION].itertuples(index=False, name=None), cart, operations)
        yield left()

    dealt = mutations.select("session", "seq", *MUTATION).repartition("session").sortWithinPartitions("session", "seq", "idempotency_key")
    return dealt.mapInPandas(run, STATE)


def idempotency_outcomes(operations: DataFrame) -> DataFrame:
    """Batch form: APPLIED for the first operation of each key, REPLAYED for the same request again, else IDEMPOTENCY_CONFLICT.

    The first request of a key is found by a map-side minimum and joined back. operations: session, idempotency_key,
    request_sha256, ts, seq.
    """
    keys = ["session", "idempotency_key"]
    first = operations.groupBy(*keys).agg(F.min(F.struct("ts", "seq", "request_sha256")).alias("first"))
    rows = operations.join(first, keys)
    outcome = F.when((F.col("ts") == F.col("first.ts")) & (F.col("seq") == F.col("first.seq")), "APPLIED").when(F.col("request_sha256") == F.col("first.request_sha256"), "REPLAYED").otherwise("IDEMPOTENCY_CONFLICT")
    return rows.select(*keys, "seq", outcome.alias("outcome"))
