"""Tenant scoping and row-level visibility.

The hosted database enforces these with row-level-security policies; here
they are plain joins a Spark job applies to whole tables: every caller's
visible rows are produced in one pass.  Joins are on equality keys only (an
``OR`` policy becomes a union of two equi-joins, never a nested loop).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import is_blank, reasons
from ..sources.sinks import SHOP_BUCKET, shop_bucket


def caller_shops(profiles: DataFrame) -> DataFrame:
    """The caller's own shop: ``(user_id, shop_id)`` from the profile table."""
    return profiles.where(F.col("shop_id").isNotNull()).select(F.col("id").alias("user_id"), "shop_id")


def rows_for_caller(table: DataFrame, profiles: DataFrame, caller: int) -> DataFrame:
    """The rows that one caller may see or change: those of the shop in the caller's profile."""
    own = caller_shops(profiles).where(F.col("user_id") == caller).select("shop_id")
    return table.join(own, "shop_id", "left_semi")


def stored_rows_for_caller(ledger: DataFrame, profiles: DataFrame, caller: int, buckets: int) -> DataFrame:
    """P2 on a ledger written with ``shop_buckets=buckets`` and read with its bucket column.

    The join on the bucket folder lets Spark take the caller's bucket from the profile at run time and
    list and read only that folder (dynamic partition pruning); the join on the shop does the rest.
    """
    own = caller_shops(profiles).where(F.col("user_id") == caller).select("shop_id").distinct()
    own = own.withColumn(SHOP_BUCKET, shop_bucket("shop_id", buckets))
    return ledger.join(own, [SHOP_BUCKET, "shop_id"], "left_semi").drop(SHOP_BUCKET)


def visible_rows(table: DataFrame, profiles: DataFrame) -> DataFrame:
    """P2 for all callers at once: every row of ``table`` with each user of its shop (rows × users of a shop;
    use ``rows_for_caller`` for one caller)."""
    return caller_shops(profiles).join(table, "shop_id", "inner")


def visible_shops(shops: DataFrame, profiles: DataFrame) -> DataFrame:
    """Shops a user owns OR the shop of the user's profile (deduplicated)."""
    owned = shops.select(F.col("owner_id").alias("user_id"), "id", "name", "owner_id").where(
        F.col("user_id").isNotNull()
    )
    mine = caller_shops(profiles).join(
        shops.select(F.col("id").alias("shop_id"), "name", "owner_id"), "shop_id", "inner"
    ).select("user_id", F.col("shop_id").alias("id"), "name", "owner_id")
    return owned.unionByName(mine).distinct()


def changeable_shops(shops: DataFrame, profiles: DataFrame) -> DataFrame:
    """P3 for update and delete: shops that a user owns AND that are the shop of the user's profile."""
    mine = caller_shops(profiles).select(F.col("user_id").alias("owner_id"), F.col("shop_id").alias("id"))
    return shops.join(mine, ["owner_id", "id"], "left_semi").select(F.col("owner_id").alias("user_id"), "id", "name", "owner_id")


def visible_profiles(profiles: DataFrame) -> DataFrame:
    """P4 (select, update, delete): a user's own profile, when it names a shop (the caller's shop is that one)."""
    return profiles.where(F.col("shop_id").isNotNull()).select(F.col("id").alias("user_id"), "id", "shop_id", "full_name", "role")


def profile_insert_check(requests: DataFrame, shops: DataFrame) -> DataFrame:
    """J5 + V8: a profile insert is allowed when the row is the caller's own,
    the role is 'owner' and the shop exists and is owned by the caller."""
    owned = shops.select(F.col("id").alias("shop_id"), F.col("owner_id").alias("caller_id"))
    checked = requests.join(
        owned.withColumn("owns", F.lit(True)), ["shop_id", "caller_id"], "left"
    )
    r = reasons(
        (~F.col("id").eqNullSafe(F.col("caller_id")) | F.col("id").isNull(), "not_own_profile"),
        (~F.col("role").eqNullSafe(F.lit("owner")), "role_not_owner"),
        (F.col("owns").isNull(), "shop_not_owned"),
    )
    return checked.select(
        "request_id", "caller_id", "id", "shop_id", "role", F.array_join(r, ";").alias("reasons")
    ).withColumn("accepted", F.col("reasons") == "")


def tenant_mismatch(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Writes that name no shop, or another than the caller's."""
    own = caller_shops(profiles).select(F.col("user_id").alias("caller_id"), F.col("shop_id").alias("own_shop_id"))
    j = requests.join(own, "caller_id", "left")
    wrong = F.col("requested_shop_id").isNull() | ~F.col("requested_shop_id").eqNullSafe(F.col("own_shop_id"))
    return j.where(wrong).select(
        "request_id", "caller_id", "requested_shop_id", "own_shop_id"
    )


def shop_delete_check(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """A shop still referenced by a profile cannot be deleted."""
    used = profiles.where(F.col("shop_id").isNotNull()).select("shop_id").distinct().withColumn("used", F.lit(True))
    return requests.join(used, "shop_id", "left").select("shop_id", F.col("used").isNull().alias("accepted"))


def onboarding_check(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """V8 (shop part): non-blank shop name and a user without a profile yet."""
    has = profiles.select(F.col("id").alias("user_id")).withColumn("has_profile", F.lit(True))
    j = requests.join(has, "user_id", "left")
    r = reasons(
        (is_blank("shop_name"), "blank_shop_name"),
        (F.col("has_profile").isNotNull(), "already_has_shop"),
    )
    return j.withColumn("reasons", F.array_join(r, ";")).drop("has_profile")
