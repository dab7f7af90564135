"""Stored tenants, machines and users (J5-J7) and the legacy migration.

A registration is committed to a change log; the stored state is its fold, the
last write of every key by ``seq``. Batches are checked as a whole (D2 rules,
known tenants) and committed or refused as a whole. ``compact`` writes the fold
of all batches so far as a snapshot and then publishes a pointer to it, so a
reader folds the newest snapshot with the batches after it. Until the pointer is
there, readers use the one before; a compaction that dies half-way leaves nothing.

Activity is a write of its own (``set_active``): registering a key again keeps it.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean, tenancy
from ..session import write_table
from . import commits, readers, sinks

# Keys, set columns and defaults of the registered tables.
KEYS = {"tenants": ["tenant_id"], "machines": ["tenant_id", "machine_id"],
        "users": ["user_id", "tenant_id"]}
SET_COLS = {"tenants": ["tenant_name", "plant_location", "timezone", "config"],
            "machines": ["machine_name", "machine_type", "capacity_units_per_hour"],
            "users": ["user_name", "user_email", "role"]}
DEFAULTS = {"tenants": {"timezone": "UTC", "config": "{}"}, "machines": {}, "users": {"role": "viewer"}}


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:      # nothing written yet
        return None


def _log_schema(table: str) -> T.StructType:
    kinds = {"capacity_units_per_hour": "double"}
    text = [f"{c} {kinds.get(c, 'string')}" for c in KEYS[table] + SET_COLS[table]]
    return T.StructType.fromDDL(", ".join(text + ["is_active boolean", "sets boolean", "seq long", "changed_at timestamp_ntz"]))


def _commit(rows: DataFrame, table: str, path: str) -> None:
    schema = _log_schema(table)
    typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    commits.append(typed, path, uuid.uuid4().hex, [])


def register(changes: DataFrame, table: str, log_path: str, tenants: DataFrame | None = None) -> bool:
    """Commit ``changes`` (keys, set columns, ``seq``, ``changed_at``) to the log.

    False, and nothing written, if a row breaks a D2 rule, a tenant's id is
    shorter than three characters (P9) or, for machines and users, a row names a
    tenant that ``tenants`` lacks.
    """
    cols = KEYS[table] + SET_COLS[table]
    filled = changes.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS[table].items()})
    rows = write_table(filled.select(*cols, "seq", "changed_at"), f"register-{table}")
    _, rejected = clean.split_by_constraints(rows, table)
    if not rejected.isEmpty():
        return False
    if table == "tenants" and not rows.filter(~tenancy.valid_tenant_id(F.col("tenant_id"))).isEmpty():
        return False
    if table != "tenants" and not tenancy.unknown_tenant_rows(rows, tenants).isEmpty():
        return False
    _commit(rows.withColumns({"is_active": F.lit(None), "sets": F.lit(True)}), table, log_path)
    return True


def set_active(changes: DataFrame, table: str, log_path: str) -> None:
    """Commit activity (keys, ``is_active``, ``seq``, ``changed_at``); keys that were
    never registered stay unknown."""
    _commit(changes.withColumns({**{c: F.lit(None) for c in SET_COLS[table]}, "sets": F.lit(False)}), table, log_path)


def _fold(log: DataFrame, table: str) -> DataFrame:
    """One row per key: values and their seq, activity and its seq, times."""
    set_seq, flag_seq = F.when(F.col("sets"), F.col("seq")), F.when(F.col("is_active").isNotNull(), F.col("seq"))
    set_time = F.when(F.col("sets"), F.col("changed_at"))
    return log.groupBy(*KEYS[table]).agg(
        F.max_by(F.struct(*SET_COLS[table]), set_seq).alias("v"), F.max(set_seq).alias("v_seq"),
        F.max_by("is_active", flag_seq).alias("active"), F.max(flag_seq).alias("a_seq"),
        F.min(set_time).alias("created_at"), F.max(set_time).alias("updated_at"))


def _merge(folds: DataFrame, table: str) -> DataFrame:
    return folds.groupBy(*KEYS[table]).agg(
        F.max_by("v", "v_seq").alias("v"), F.max("v_seq").alias("v_seq"),
        F.max_by("active", "a_seq").alias("active"), F.max("a_seq").alias("a_seq"),
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def _pointer(spark: SparkSession, log_path: str) -> tuple[int, str | None]:
    """The newest published snapshot: (version, folder)."""
    try:
        last = spark.read.schema("version long, snapshot string").json(f"{log_path}/pointers").agg(
            F.max(F.struct("version", "snapshot")).alias("p")).select("p.*").first()
    except AnalysisException:      # never compacted
        return 0, None
    return (last.version, last.snapshot) if last.version is not None else (0, None)


def _state(spark: SparkSession, table: str, log_path: str, batches: DataFrame) -> DataFrame:
    """The fold of ``batches``, by way of the newest snapshot."""
    _, snapshot = _pointer(spark, log_path)
    if snapshot is None:
        return _fold(commits.read(spark, log_path, _log_schema(table), batches), table)
    covered = spark.read.schema("batch string").parquet(f"{snapshot}/covered")
    later = _fold(commits.read(spark, log_path, _log_schema(table), batches.join(covered, "batch", "left_anti")), table)
    return _merge(spark.read.schema(later.schema).parquet(f"{snapshot}/state").unionByName(later), table)


def compact(spark: SparkSession, table: str, log_path: str) -> bool:
    """Write the state of all batches committed so far and point readers to it.
    False if another compaction published first; its snapshot then counts."""
    version, _ = _pointer(spark, log_path)
    snapshot = f"{log_path}/snapshots/{uuid.uuid4().hex}"
    commits.committed(spark, log_path).select("batch").write.parquet(f"{snapshot}/covered")
    covered = spark.read.schema("batch string").parquet(f"{snapshot}/covered")
    _state(spark, table, log_path, covered).write.parquet(f"{snapshot}/state")
    return commits.publish(spark, {"version": version + 1, "snapshot": snapshot}, f"{log_path}/pointers", f"{version + 1:012d}")


def registered(spark: SparkSession, table: str, log_path: str) -> DataFrame:
    """The latest state per key: last write wins, also with nulls; a key is
    active unless its last activity says otherwise."""
    state = _state(spark, table, log_path, commits.committed(spark, log_path)).filter("v_seq IS NOT NULL")
    return state.select(*KEYS[table], *[F.col("v")[c].alias(c) for c in SET_COLS[table]],
                        F.coalesce("active", F.lit(True)).alias("is_active"), "created_at",
                        *(["updated_at"] if table == "tenants" else []))


def migrate(spark: SparkSession, legacy_table: str, tenant_id: str, target_path: str) -> bool:
    """J3 end to end: probe (S8), select what the target lacks, append (K2).

    A missing legacy table means there is nothing to do, which is a success.
    """
    if not readers.table_exists(spark, legacy_table):
        return True
    legacy, target = spark.table(legacy_table), _read(spark, target_path)
    if target is None:
        rows = tenancy.tag_tenant(legacy, tenant_id).select(*tenancy.MIGRATED_COLS)
    else:
        rows = tenancy.migrate_legacy(legacy, target, tenant_id)
    rows = write_table(rows, "migrate")    # the target's state before the append
    if not rows.isEmpty():
        sinks.append_tenant_production(rows, target_path)
    return True
