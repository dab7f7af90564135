"""Renaming, coercion, cleaning rules and the validation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.schemas import DISPLAY_NAMES, MEASURES, NOT_NULL, VARCHAR_LIMITS

STORAGE_NAMES = {v: k for k, v in DISPLAY_NAMES.items()}

# Validation log texts.
MSG_MISSING = "Missing values detected and zeroed."
MSG_NEGATIVE = "Negative values in {col} corrected."
MSG_CAPPED = "Defects exceeded production; capped at production value."
MSG_OK = "Validation successful: No errors found in the dataset."
LOG_HEADER = "VALIDATION ERRORS FOUND AND FIXED:"


def to_display(df: DataFrame) -> DataFrame:
    """P1 storage -> display names (columns not in the map are kept)."""
    return df.withColumnsRenamed({k: v for k, v in DISPLAY_NAMES.items() if k in df.columns})


def to_storage(df: DataFrame) -> DataFrame:
    """P1 display -> storage names."""
    return df.withColumnsRenamed({k: v for k, v in STORAGE_NAMES.items() if k in df.columns})


def coerce_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P2 ``to_numeric(errors='coerce').fillna(0)``: bad text -> null -> 0."""
    cols = [c for c in (cols or MEASURES) if c in df.columns]
    return df.withColumns({
        c: F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")),
                      F.lit(0.0))
        for c in cols})


def fill_nulls(df: DataFrame) -> DataFrame:
    """P10 ``fillna(0)``: numerics -> 0, strings -> '0'; dates stay null.

    NaN counts as missing (pandas semantics), so it is mapped to null first.
    """
    fills = {}
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            fills[f.name] = F.coalesce(F.nanvl(c, F.lit(None).cast(f.dataType)),
                                       F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.NumericType):
            fills[f.name] = F.coalesce(c, F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            fills[f.name] = F.coalesce(c, F.lit("0"))
    return df.withColumns(fills)


def clip_negative(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P11 negative measures -> 0; a null measure stays null."""
    cols = [c for c in (cols or MEASURES) if c in df.columns]
    return df.withColumns({c: F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c)) for c in cols})


def cap_defects(df: DataFrame) -> DataFrame:
    """P12 defects cannot exceed units; next to unknown units they stay."""
    d, u = F.col("defective_units"), F.col("units_produced")
    return df.withColumn("defective_units", F.when(d > u, u).otherwise(d))


def validate(df: DataFrame) -> DataFrame:
    """C2 cleaning, in the reference's order: fill, clip, cap."""
    return cap_defects(clip_negative(fill_nulls(df)))


def _any_null(df: DataFrame) -> Column:
    conds = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            conds.append(c.isNull() | F.isnan(c))
        else:
            conds.append(c.isNull())
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def validation_report(df: DataFrame) -> DataFrame:
    """P13 which rules fired (one aggregate pass), as (rule, message, n_rows).

    The reference writes only the messages; row counts are added. If no rule
    fired the single row is the success message with n_rows 0.
    """
    measures = [c for c in MEASURES if c in df.columns]
    # fill -> clip -> cap, restated as predicates over the raw row
    neg = {c: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(0.0)) < 0
           for c in measures}
    u = F.greatest(F.coalesce(F.nanvl(F.col("units_produced"), F.lit(None).cast("double")),
                              F.lit(0.0)), F.lit(0.0))
    d = F.greatest(F.coalesce(F.nanvl(F.col("defective_units"), F.lit(None).cast("double")),
                              F.lit(0.0)), F.lit(0.0))
    agg = df.agg(
        F.count_if(_any_null(df)).alias("missing"),
        *[F.count_if(neg[c]).alias(f"neg_{c}") for c in measures],
        F.count_if(d > u).alias("capped"))
    specs = [("missing", MSG_MISSING, "missing")]
    specs += [(f"negative:{c}", MSG_NEGATIVE.format(col=DISPLAY_NAMES[c]), f"neg_{c}")
              for c in measures]
    specs += [("capped", MSG_CAPPED, "capped")]
    rules = [F.struct(F.lit(i + 1).alias("step"), F.lit(rule).alias("rule"),
                      F.lit(msg).alias("message"), F.col(src).alias("n_rows"))
             for i, (rule, msg, src) in enumerate(specs)]
    ok = F.array(F.struct(F.lit(0).alias("step"), F.lit("ok").alias("rule"),
                          F.lit(MSG_OK).alias("message"),
                          F.lit(0).cast("bigint").alias("n_rows")))
    fired = F.filter(F.array(*rules), lambda r: r["n_rows"] > 0)
    return (agg.select(F.explode(F.when(F.size(fired) > 0, fired).otherwise(ok)).alias("r"))
            .select("r.step", "r.rule", "r.message", "r.n_rows"))


def validation_log_text(report: DataFrame) -> DataFrame:
    """K3 the log file body (one row, one string) from the rule report."""
    msgs = F.array_join(F.sort_array(F.collect_list(F.struct("step", "message")))["message"],
                        "\n")
    return report.agg(
        F.when(F.max(F.col("rule") == "ok"), F.lit(MSG_OK))
         .otherwise(F.concat(F.lit(LOG_HEADER + "\n"), msgs)).alias("text"))


def union_sources(history: DataFrame, live: DataFrame) -> DataFrame:
    """U1 union-all by name, missing columns null, duplicates kept."""
    return history.unionByName(live, allowMissingColumns=True)


def constraint_violation(df: DataFrame, table: str) -> Column:
    """D2 first NOT NULL / VARCHAR(n) rule a row breaks, or null."""
    checks = []
    for c in NOT_NULL.get(table, []):
        if c in df.columns:
            checks.append((F.col(c).isNull(), f"not_null:{c}"))
    for c, n in VARCHAR_LIMITS.get(table, {}).items():
        if c in df.columns:
            checks.append((F.length(F.col(c)) > n, f"varchar{n}:{c}"))
    expr = F.lit(None).cast("string")
    for cond, label in reversed(checks):
        expr = F.when(F.coalesce(cond, F.lit(False)), F.lit(label)).otherwise(expr)
    return expr


def split_by_constraints(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """D2 (accepted, rejected-with-reason) for an all-or-nothing write."""
    tagged = df.withColumn("_violation", constraint_violation(df, table))
    accepted = tagged.filter(F.col("_violation").isNull()).drop("_violation")
    rejected = tagged.filter(F.col("_violation").isNotNull()).withColumnRenamed(
        "_violation", "violation")
    return accepted, rejected
