"""Conservation of money: by segment and currency every minor unit is in exactly one account."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Accounts of the left side that a two-sided group's type names.
_TWO_SIDED = {"AMOUNT_MISMATCH": "amount", "GROUP_SUM_MISMATCH": "group_sum", "TIMING": "timing", "STATUS_MISMATCH": "status", "DUPLICATE": "duplicate"}
LEFT_ACCOUNTS = ["matched_left", "missing", "amount", "group_sum", "timing", "status", "duplicate", "bridge_left", "currency_left", "fx_left", "suppressed_left"]
RIGHT_ACCOUNTS = ["matched_right", "extra", "bridge_right", "currency_right", "fx_right", "suppressed_right"]


def conservation_report(classified: DataFrame) -> DataFrame:
    """One row for each run, segment and currency: totals, accounts, residuals and whether both residuals are 0.

    A group gives at most one amount to each side's currency. Types that the rules suppressed keep their money visible:
    one-sided, currency and exchange-rate groups go to the suppressed accounts, others to the matched ones.
    """
    both, left_only = F.col("presence") == "BOTH", F.col("presence") == "LEFT_ONLY"
    t, raw = F.col("type"), F.col("raw_type")
    pairs = [(F.col("type") == k, v) for k, v in _TWO_SIDED.items()]
    left = F.when(both & t.isNull() & raw.isin("CURRENCY_MISMATCH", "FX_RATE_DIFF"), "suppressed_left").when(both & t.isNull(), "matched_left").when(both & (t == "CURRENCY_MISMATCH"), "currency_left").when(both & (t == "FX_RATE_DIFF"), "fx_left")
    for condition, account in pairs:
        left = left.when(both & condition, account)
    left = left.when(left_only & (t == "BRIDGE_BROKEN"), "bridge_left").when(left_only & (t == "MISSING"), "missing").otherwise("suppressed_left")
    right = (
        F.when(both & t.isNull() & raw.isin("CURRENCY_MISMATCH", "FX_RATE_DIFF"), "suppressed_right").when(both & (t == "CURRENCY_MISMATCH"), "currency_right").when(both & (t == "FX_RATE_DIFF"), "fx_right")
        .when(both & (t.isNull() | t.isin(*_TWO_SIDED)), "matched_right").when((F.col("presence") == "RIGHT_ONLY") & (t == "BRIDGE_BROKEN"), "bridge_right").when((F.col("presence") == "RIGHT_ONLY") & (t == "EXTRA"), "extra").otherwise("suppressed_right")
    )
    sides = F.array(
        F.when(F.col("left_count") > 0, F.struct(F.col("left_currency").alias("currency"), F.lit("L").alias("side"), left.alias("account"), F.col("left_sum").alias("amount"))),
        F.when(F.col("right_count") > 0, F.struct(F.col("right_currency").alias("currency"), F.lit("R").alias("side"), right.alias("account"), F.col("right_sum").alias("amount"))),
    )
    rows = classified.select("run_id", "segment_id", F.explode(F.array_compact(sides)).alias("x")).select("run_id", "segment_id", "x.*")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("amount"))), F.lit(0))
    sums = rows.groupBy("run_id", "segment_id", "currency").agg(
        total(F.col("side") == "L").alias("expected_total"), total(F.col("side") == "R").alias("right_total"), *[total(F.col("account") == a).alias(a) for a in LEFT_ACCOUNTS + RIGHT_ACCOUNTS]
    )
    plus = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0]))
    out = sums.withColumns({"left_residual": F.col("expected_total") - plus(LEFT_ACCOUNTS), "right_residual": F.col("right_total") - plus(RIGHT_ACCOUNTS)})
    return out.withColumns({
        "currency_mismatch": F.col("currency_left") + F.col("currency_right"), "bridge_broken": F.col("bridge_left") + F.col("bridge_right"),
        "balanced": (F.col("left_residual") == 0) & (F.col("right_residual") == 0),
    })


def independent_totals(records: DataFrame) -> DataFrame:
    """Totals of the records themselves, to hold the report against."""
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("signed_amount_minor"))), F.lit(0))
    return records.groupBy("run_id", "segment_id", "currency").agg(side("LEFT").alias("record_left"), side("RIGHT").alias("record_right"))


def proven_report(report: DataFrame, records: DataFrame) -> DataFrame:
    """The report, with balanced only where its totals equal those of the records as well."""
    out = report.join(independent_totals(records), ["run_id", "segment_id", "currency"], "left")
    same = (F.col("expected_total") == F.coalesce("record_left", F.lit(0))) & (F.col("right_total") == F.coalesce("record_right", F.lit(0)))
    return out.withColumn("balanced", F.col("balanced") & same).drop("record_left", "record_right")
