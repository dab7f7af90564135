"""Tenant-scoped reads, cross-tenant roll-ups, migration and upserts.

Upserts are expressed without MERGE (Parquet tables have no row-level
writes): the incoming batch is reduced to one row per key (last write wins,
a bounded per-key aggregate), then full-outer-joined to the current state
and resolved column by column. The result is a new version of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import AsOf, trailing_window

TENANT_SCAN_COLS = ["production_date", "machine_id", "units_produced",
                    "defective_units", "downtime_min", "shift"]


# --------------------------------------------------------------------------
# scans (S2, S3, S9, S10) and predicates
# --------------------------------------------------------------------------

def for_tenant(df: DataFrame, tenant_id: str) -> DataFrame:
    """P5 tenant isolation: the mandatory predicate of every tenant reader.

    On a table partitioned by ``tenant_id`` this is a partition filter.
    """
    return df.filter(F.col("tenant_id") == F.lit(tenant_id))


def machine_filter(df: DataFrame, machine_id: str | None) -> DataFrame:
    """P4 optional machine equality filter."""
    return df if not machine_id else df.filter(F.col("machine_id") == F.lit(machine_id))


def active_only(df: DataFrame, enabled: bool = True) -> DataFrame:
    """P6 optional ``is_active`` filter."""
    return df.filter(F.col("is_active")) if enabled else df


def tag_tenant(df: DataFrame, tenant_id: str) -> DataFrame:
    """P8 constant tenant column."""
    return df.withColumn("tenant_id", F.lit(tenant_id))


def valid_tenant_id(c: Column) -> Column:
    """P9 tenant ids need at least 3 characters."""
    return F.coalesce(F.length(c) >= 3, F.lit(False))


def production_query(prod: DataFrame, days: int = 7, as_of: AsOf = None,
                     machine_id: str | None = None) -> DataFrame:
    """S3 + O1 GET /api/production: window, optional machine, newest first."""
    out = machine_filter(trailing_window(prod, days, as_of), machine_id)
    return out.orderBy(F.col("production_date").desc(), F.col("machine_id").asc())


def tenant_production(prod: DataFrame, tenant_id: str, days: int = 7,
                      as_of: AsOf = None, machine_id: str | None = None) -> DataFrame:
    """S2 tenant production scan: six named columns, newest first."""
    out = machine_filter(trailing_window(for_tenant(prod, tenant_id), days, as_of),
                         machine_id)
    return (out.select(*TENANT_SCAN_COLS)
            .orderBy(F.col("production_date").desc(), F.col("machine_id").asc()))


def tenant_list(tenants: DataFrame, active: bool = True) -> DataFrame:
    """S9 tenant list, ordered by name."""
    return active_only(tenants, active).orderBy("tenant_name")


def tenant_machines(machines: DataFrame, tenant_id: str | None = None,
                    active: bool = True) -> DataFrame:
    """S10 machines of a tenant (or of all tenants, batch form), by machine."""
    df = machines if tenant_id is None else for_tenant(machines, tenant_id)
    keys = ["machine_id"] if tenant_id is not None else ["tenant_id", "machine_id"]
    return active_only(df, active).orderBy(*keys)


# --------------------------------------------------------------------------
# J1 + A5 cross-tenant summary
# --------------------------------------------------------------------------

def cross_tenant_summary(tenants: DataFrame, prod: DataFrame, days: int = 7,
                         as_of: AsOf = None) -> DataFrame:
    """A5 corporate summary over active tenants (quiet tenants keep nulls).

    Plan: the window filter goes to the fact scan, facts are reduced to one
    row per tenant *before* the join (partial aggregation absorbs a hot
    tenant), and the LEFT JOIN from the tenant dimension meets at most one
    row per tenant -- AQE turns it into a broadcast from measured sizes.
    """
    facts = (trailing_window(prod, days, as_of)
             .groupBy("tenant_id")
             .agg(F.countDistinct("machine_id").alias("total_machines"),
                  F.sum("units_produced").alias("total_units"),
                  F.sum("defective_units").alias("total_defects"),
                  F.avg("downtime_min").alias("avg_downtime")))
    dims = active_only(tenants).select("tenant_id", "tenant_name", "plant_location")
    u, d = F.col("total_units"), F.col("total_defects")
    return (dims.join(facts, "tenant_id", "left")
            .select("tenant_id", "tenant_name", "plant_location",
                    F.coalesce(F.col("total_machines"), F.lit(0)).alias("total_machines"),
                    "total_units", "total_defects", "avg_downtime",
                    F.round((u - d) * 100.0 / F.nullif(u, F.lit(0.0)), 2)
                     .alias("yield_percentage"))
            .orderBy(F.col("total_units").desc_nulls_last()))


# --------------------------------------------------------------------------
# J2 user -> tenants
# --------------------------------------------------------------------------

def user_tenants(tenants: DataFrame, users: DataFrame,
                 user_id: str | None = None) -> DataFrame:
    """J2 tenants a user may see: both sides active; adds role, name, email.

    ``user_id=None`` is the batch form (every user's list).
    """
    u = users.filter(F.col("is_active"))
    if user_id is not None:
        u = u.filter(F.col("user_id") == F.lit(user_id))
    u = u.select("user_id", "tenant_id", "role", "user_name", "user_email")
    t = active_only(tenants)
    return t.join(u, "tenant_id", "inner").orderBy("user_id", "tenant_name")


# --------------------------------------------------------------------------
# J3 legacy migration, J4 referential check
# --------------------------------------------------------------------------

MIGRATED_COLS = ["tenant_id", "production_date", "machine_id", "units_produced",
                 "defective_units", "downtime_min", "shift"]


def migrate_legacy(legacy: DataFrame, target: DataFrame, tenant_id: str) -> DataFrame:
    """J3 rows of the legacy table to insert for ``tenant_id``.

    A legacy row goes in unless the target already holds the same
    (date, machine) for that tenant; duplicates inside the legacy source all
    go in (the statement reads one snapshot). Shift is not part of the key,
    as in the reference. Running it again against the grown target adds
    nothing.
    """
    existing = (for_tenant(target, tenant_id)
                .select("production_date", "machine_id").distinct())
    rows = legacy.join(existing, ["production_date", "machine_id"], "left_anti")
    return tag_tenant(rows, tenant_id).select(*MIGRATED_COLS)


def unknown_tenant_rows(batch: DataFrame, tenants: DataFrame) -> DataFrame:
    """J4 rows whose tenant is not registered (FK violation)."""
    return batch.join(tenants.select("tenant_id"), "tenant_id", "left_anti")


def referential_check(batch: DataFrame, tenants: DataFrame) -> DataFrame:
    """J4 verdict for a batch: one row with counts and ``accepted``.

    One aggregate over a left join with the (deduplicated) tenant keys; the
    batch is rejected as a whole if any row names an unknown tenant.
    """
    known = tenants.select("tenant_id").distinct().withColumn("_known", F.lit(True))
    return (batch.select("tenant_id").join(known, "tenant_id", "left")
            .agg(F.count(F.lit(1)).alias("batch_rows"),
                 F.count_if(F.col("_known").isNull()).alias("unknown_rows"))
            .withColumn("accepted", F.col("unknown_rows") == 0))


# --------------------------------------------------------------------------
# J5-J7 upserts
# --------------------------------------------------------------------------

def latest_per_key(batch: DataFrame, keys: list[str], seq: str | None,
                   cols: list[str]) -> DataFrame:
    """Reduce a change batch to its last write per key (``max_by(.., seq)``).

    An aggregate, not a window: partial aggregation keeps a hot key to one
    row per partition before the shuffle.
    """
    if seq is None:
        # without a sequence there is no last write: a repeated key is an error
        again = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        return (batch.select(*keys, *cols, again.alias("_again"))
                .filter(F.assert_true(F.col("_again") == 1, "a key repeats and seq is not given").isNull())
                .drop("_again"))
    packed = F.struct(*[F.col(c) for c in cols])
    return (batch.groupBy(*keys)
            .agg(F.max_by(packed, F.col(seq)).alias("_v"))
            .select(*keys, *[F.col("_v")[c].alias(c) for c in cols]))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str],
           set_cols: list[str], insert_defaults: dict[str, Column],
           on_update: dict[str, Column] | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (keys) DO UPDATE SET set_cols (+ on_update).

    ``incoming`` must already hold one row per key. On conflict the incoming
    value wins even when null (presence is tracked by a flag, not by
    ``coalesce``). Columns outside ``set_cols`` keep their stored value;
    inserted rows take ``insert_defaults`` for columns the batch lacks.
    """
    on_update = on_update or {}
    cur_cols = current.columns
    inc = incoming.select(*keys, *set_cols).withColumn("_in", F.lit(True))
    cur = current.withColumn("_cur", F.lit(True))
    cur_alias, inc_alias = cur.alias("c"), inc.alias("i")
    joined = cur_alias.join(inc_alias, keys, "full_outer")
    in_batch = F.coalesce(F.col("i._in"), F.lit(False))
    in_current = F.coalesce(F.col("c._cur"), F.lit(False))
    out = []
    for c in cur_cols:
        if c in keys:
            out.append(F.col(c))
        elif c in set_cols:
            out.append(F.when(in_batch, F.col(f"i.{c}")).otherwise(F.col(f"c.{c}")).alias(c))
        elif c in on_update:
            out.append(F.when(in_batch & in_current, on_update[c])
                       .when(in_batch, insert_defaults.get(c, F.lit(None)))
                       .otherwise(F.col(f"c.{c}")).alias(c))
        else:
            default = insert_defaults.get(c, F.lit(None))
            out.append(F.when(in_current, F.col(f"c.{c}")).otherwise(default).alias(c))
    return joined.select(*out)


def upsert_tenants(current: DataFrame, incoming: DataFrame, now: Column,
                   seq: str | None = None) -> DataFrame:
    """J5 create_tenant: set name, location, timezone, config, updated_at."""
    inc = latest_per_key(
        incoming.withColumn("config", F.coalesce(F.col("config"), F.lit("{}")))
                .withColumn("timezone", F.coalesce(F.col("timezone"), F.lit("UTC"))),
        ["tenant_id"], seq, ["tenant_name", "plant_location", "timezone", "config"])
    return upsert(current, inc, ["tenant_id"],
                  ["tenant_name", "plant_location", "timezone", "config"],
                  insert_defaults={"is_active": F.lit(True), "created_at": now,
                                   "updated_at": now, "timezone": F.lit("UTC"),
                                   "config": F.lit("{}")},
                  on_update={"updated_at": now})


def upsert_machines(current: DataFrame, incoming: DataFrame, now: Column,
                    seq: str | None = None, each: bool = False) -> DataFrame:
    """J6 register_machine: set name, type, capacity (null included).

    With ``each`` a key may repeat on both sides and every incoming row is
    applied to every stored row of its key: one row per pair, none is lost.
    """
    set_cols = ["machine_name", "machine_type", "capacity_units_per_hour"]
    inc = incoming if each else latest_per_key(incoming, ["tenant_id", "machine_id"], seq, set_cols)
    return upsert(current, inc, ["tenant_id", "machine_id"], set_cols,
                  insert_defaults={"is_active": F.lit(True), "created_at": now})


def upsert_users(current: DataFrame, incoming: DataFrame, now: Column,
                 seq: str | None = None) -> DataFrame:
    """J7 grant_user_access: set name, email, role; keep ``is_active``."""
    set_cols = ["user_name", "user_email", "role"]
    inc = latest_per_key(
        incoming.withColumn("role", F.coalesce(F.col("role"), F.lit("viewer"))),
        ["user_id", "tenant_id"], seq, set_cols)
    return upsert(current, inc, ["user_id", "tenant_id"], set_cols,
                  insert_defaults={"is_active": F.lit(True), "created_at": now,
                                   "role": F.lit("viewer")})


def fold_grants(grants: DataFrame) -> DataFrame:
    """J7 applied to a whole change log from an empty table.

    Per (user, tenant): name/email/role of the last grant; ``is_active`` as
    written by the first grant (the insert), since later grants keep it.
    """
    return (grants.groupBy("user_id", "tenant_id")
            .agg(F.max_by(F.struct("user_name", "user_email", "role"), F.col("seq"))
                  .alias("_v"),
                 F.min_by(F.col("is_active"), F.col("seq")).alias("is_active"),
                 F.count(F.lit(1)).alias("n_grants"))
            .select("user_id", "tenant_id", "_v.user_name", "_v.user_email",
                    "_v.role", "is_active", "n_grants"))
