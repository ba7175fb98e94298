"""Three-way import: desired state against current target and stored mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(desired: DataFrame, current: DataFrame, mapped: DataFrame) -> DataFrame:
    """entity_key, action, id. Only keys and hashes are joined; all three sides are dealt by the same key.

    desired: entity_key, managed_hash. current: entity_key, id, managed_hash. mapped: entity_key, target_id, managed_hash.
    """
    now = current.groupBy("entity_key").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("managed_hash").alias("current_hash"))
    known = mapped.select("entity_key", "target_id", F.col("managed_hash").alias("mapped_hash"))
    rows = desired.select("entity_key", F.col("managed_hash").alias("desired_hash")).join(now, "entity_key", "left").join(known, "entity_key", "left")
    is_mapped = F.col("target_id").isNotNull()
    action = (
        F.when(F.col("n") > 1, "DUPLICATE_EXTERNAL_ID")
        .when(is_mapped & (F.col("id").isNull() | (F.col("target_id") != F.col("id"))), "MAPPING_DRIFT")
        .when(F.col("id").isNull(), "created")
        .when(F.col("desired_hash") == F.col("current_hash"), F.when(is_mapped, "skipped").otherwise("reconciled"))
        .when(~is_mapped | (F.col("mapped_hash") != F.col("current_hash")), "USER_EDIT_CONFLICT")
        .otherwise("updated")
    )
    return rows.select("entity_key", action.alias("action"), "id", "desired_hash")


CONFLICTS = ("DUPLICATE_EXTERNAL_ID", "MAPPING_DRIFT", "USER_EDIT_CONFLICT")


def summary(planned: DataFrame) -> DataFrame:
    return planned.groupBy("action").agg(F.count("*").alias("n"))


def apply(planned: DataFrame, mapped: DataFrame, operations: DataFrame, package_hash: str) -> tuple[DataFrame, DataFrame]:
    """(new mapping, new operations). A plan with conflicts fails; replaying an applied plan changes nothing.

    New entities get their id from the target later; the mapping holds their key and hashes meanwhile.
    """
    bad = planned.filter(F.col("action").isin(*CONFLICTS)).limit(1).count()
    if bad:
        raise ValueError("a plan with conflicts cannot be applied")
    fresh = planned.select("entity_key", F.col("id").alias("new_id"), F.col("desired_hash"))
    joined = mapped.join(fresh, "entity_key", "full")
    mapping = joined.select("entity_key", F.coalesce("target_id", "new_id").alias("target_id"), F.coalesce("desired_hash", "managed_hash").alias("managed_hash"))
    made = planned.filter("action != 'skipped'").select(F.sha2(F.concat_ws("|", F.lit(package_hash), "entity_key"), 256).alias("operation_key"), F.lit(package_hash).alias("package_hash"), "entity_key", F.col("action").alias("result"))
    new = made.join(operations.select("operation_key"), "operation_key", "left_anti")
    return mapping, operations.select("operation_key", "package_hash", "entity_key", "result").unionByName(new)


def upsert_routes(stored: DataFrame, desired: DataFrame) -> DataFrame:
    new = desired.select("route_key", *[F.col(c).alias(f"_{c}") for c in ("request_target", "entity_key", "status", "redirect_target")], F.lit(True).alias("_new"))
    rows = stored.join(new, "route_key", "full")
    pick = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("route_key", *[pick(c) for c in ("request_target", "entity_key", "status", "redirect_target")])


def reconcile(desired: DataFrame, current: DataFrame, mapped: DataFrame, routes: DataFrame, target_routes: DataFrame, assets: DataFrame, files: DataFrame) -> DataFrame:
    """kind, key, reason of every defect of an applied import; empty if it is whole.

    desired/current/mapped as in plan; routes/target_routes: route_key, status, entity_key, redirect_target;
    assets: sha256 that must be there; files: sha256 that are.
    """
    now = current.select("entity_key", "id", F.col("managed_hash").alias("current_hash"))
    known = mapped.select("entity_key", "target_id", F.col("managed_hash").alias("mapped_hash"))
    e = desired.select("entity_key", "managed_hash").join(now, "entity_key", "left").join(known, "entity_key", "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("id").isNull(), F.lit("ENTITY_MISSING")),
            F.when(F.col("current_hash") != F.col("managed_hash"), F.lit("ENTITY_CHANGED")),
            F.when(F.col("target_id").isNull(), F.lit("MAPPING_MISSING")),
            F.when(F.col("target_id") != F.col("id"), F.lit("MAPPING_DRIFT")),
            F.when(F.col("mapped_hash") != F.col("managed_hash"), F.lit("MAPPING_HASH_STALE")),
        )
    )
    entity = e.select(F.lit("entity").alias("kind"), F.col("entity_key").alias("key"), F.explode(reasons).alias("reason"))
    t = target_routes.select("route_key", *[F.col(c).alias(f"_{c}") for c in ("status", "entity_key", "redirect_target")], F.lit(True).alias("_there"))
    r = routes.join(t, "route_key", "full")
    same = F.col("status").eqNullSafe(F.col("_status")) & F.col("entity_key").eqNullSafe(F.col("_entity_key")) & F.col("redirect_target").eqNullSafe(F.col("_redirect_target"))
    reason = F.when(F.col("_there").isNull(), "ROUTE_MISSING").when(F.col("status").isNull(), "ROUTE_UNEXPECTED").when(~same, "ROUTE_CHANGED")
    route = r.select(F.lit("route").alias("kind"), F.col("route_key").alias("key"), reason.alias("reason")).filter("reason is not null")
    wanted, there = assets.select("sha256").distinct(), files.select("sha256").distinct()
    asset = wanted.join(there, "sha256", "left_anti").select(F.lit("asset").alias("kind"), F.col("sha256").alias("key"), F.lit("ASSET_MISSING").alias("reason"))
    orphan = there.join(wanted, "sha256", "left_anti").select(F.lit("asset").alias("kind"), F.col("sha256").alias("key"), F.lit("FILE_UNREFERENCED").alias("reason"))
    return entity.unionByName(route).unionByName(asset).unionByName(orphan)


def catalog_plan(desired: DataFrame, current: DataFrame, records: DataFrame) -> DataFrame:
    """item_key, action of a catalog import with checkpoints.

    desired: item_key, input_hash, after_hash. current: item_key, hash. records: item_key, state (PENDING, COMMITTED),
    input_hash, before_hash, after_hash, recoverable.
    """
    rec = records.select("item_key", "state", *[F.col(c).alias(f"rec_{c}") for c in ("input_hash", "before_hash", "after_hash")], "recoverable")
    rows = desired.join(current.select("item_key", F.col("hash").alias("current_hash")), "item_key", "full").join(rec, "item_key", "full")
    now = F.col("current_hash")
    pending, committed = F.col("state") == "PENDING", F.col("state") == "COMMITTED"
    action = (
        F.when(F.col("input_hash").isNull(), F.when(F.col("state").isNotNull(), "retained-outside-scope"))
        .when(F.col("state").isNull(), F.when(now.isNotNull(), "UNOWNED_DATA_CONFLICT").otherwise("created"))
        .when(pending & (F.col("rec_input_hash") != F.col("input_hash")), "PENDING_INTENT_CONFLICT")
        .when(pending & now.eqNullSafe(F.col("rec_after_hash")), F.when(F.col("recoverable"), "reconciled").otherwise("RECOVERY_CONFLICT"))
        .when(pending & now.eqNullSafe(F.col("rec_before_hash")), "recovered-before-write")
        .when(pending, "THIRD_VALUE_CONFLICT")
        .when(committed & ~now.eqNullSafe(F.col("rec_after_hash")), "USER_EDIT_CONFLICT")
        .when(committed & (F.col("rec_input_hash") == F.col("input_hash")), "skipped")
        .otherwise("updated")
    )
    return rows.select("item_key", action.alias("action")).filter("action is not null")


def not_reconciled(planned: DataFrame) -> DataFrame:
    """Items of a catalog plan that are not ``skipped``: a whole import has none."""
    return planned.filter(~F.col("action").isin("skipped", "retained-outside-scope"))


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The new version of a keyed table with an ``action`` column: created, skipped, conflict (row kept), updated.

    stored: project, type, source_id, fields, baseline. incoming: project, type, source_id, fields; a repeated key fails.
    """
    keys = ["project", "type", "source_id"]
    fresh = incoming.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("fields").alias("_new"))
    rows = stored.join(fresh, keys, "full")
    old, new, base = F.col("fields"), F.col("_new"), F.col("baseline")
    twice = F.when(F.col("_n") > 1, F.raise_error(F.lit("an input key is repeated")).cast("string"))
    action = F.coalesce(twice, F.when(new.isNull(), "kept").when(old.isNull(), "created").when(old == new, "skipped").when(old != base, "conflict").otherwise("updated"))
    writes = action.isin("created", "updated")
    return rows.select(*keys, F.when(writes, new).otherwise(old).alias("fields"), F.when(writes, new).otherwise(base).alias("baseline"), action.alias("action"))
