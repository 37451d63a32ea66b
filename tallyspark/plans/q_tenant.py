"""Tenant scoping queries."""

from __future__ import annotations

from ..operators import reports as R
from ..operators import tenant as TN
from ..sources import fixtures as fx
from .oracle_tables import with_tables
from .q_sources import SALES_D
from .registry import query

TENANT = 7


@query("sales_for_shop", with_tables(SALES_D.format(src=f"t_sales WHERE shop_id = {TENANT}"), "t_sales"))
def sales_for_shop(t):
    """The sales of one shop (filter pushed to the scan)."""
    from ..operators import history as H

    return H.sales_history(R.for_shop(fx.sales(t), TENANT))


@query(
    "rls_visible_sales",
    with_tables(
        "SELECT p.id AS user_id, s.shop_id, s.id, s.product_id, s.product_name, s.quantity, s.sale_date, "
        "s.revenue, s.profit FROM t_profiles p JOIN t_sales s ON s.shop_id = p.shop_id",
        "t_profiles",
        "t_sales",
    ),
)
def rls_visible_sales(t):
    """Every sale paired with each user allowed to see it."""
    from ..functions.expr import to_double

    v = TN.visible_rows(fx.sales(t), fx.profiles(t))
    return v.withColumn("revenue", to_double("revenue")).withColumn("profit", to_double("profit"))


@query(
    "rls_visible_shops",
    with_tables(
        "SELECT owner_id AS user_id, id, name, owner_id FROM t_shops WHERE owner_id IS NOT NULL UNION "
        "SELECT p.id AS user_id, s.id, s.name, s.owner_id FROM t_profiles p JOIN t_shops s ON s.id = p.shop_id",
        "t_shops",
        "t_profiles",
    ),
)
def rls_visible_shops(t):
    """Shops each user may see (owner OR member)."""
    return TN.visible_shops(fx.shops(t), fx.profiles(t))


CALLER = 2


@query(
    "rls_caller_sales",
    with_tables(
        SALES_D.format(src=f"t_sales WHERE shop_id IN (SELECT shop_id FROM t_profiles WHERE id = {CALLER})"),
        "t_sales",
        "t_profiles",
    ),
)
def rls_caller_sales(t):
    """The sales that one caller may see (semi-join on the caller's shop)."""
    from ..operators import history as H

    return H.sales_history(TN.rows_for_caller(fx.sales(t), fx.profiles(t), CALLER))


@query(
    "rls_changeable_shops",
    with_tables(
        "SELECT s.owner_id AS user_id, s.id, s.name, s.owner_id FROM t_shops s JOIN t_profiles p "
        "ON p.id = s.owner_id AND p.shop_id = s.id",
        "t_shops",
        "t_profiles",
    ),
)
def rls_changeable_shops(t):
    """Shops each user may update or delete (owner AND member)."""
    return TN.changeable_shops(fx.shops(t), fx.profiles(t))


@query(
    "rls_visible_profile",
    with_tables(
        "SELECT id AS user_id, id, shop_id, full_name, role FROM t_profiles WHERE shop_id IS NOT NULL", "t_profiles"
    ),
)
def rls_visible_profile(t):
    """Own-profile visibility."""
    return TN.visible_profiles(fx.profiles(t))


@query(
    "profiles_insert_check",
    with_tables(
        "SELECT request_id, caller_id, id, shop_id, role, reasons, reasons = '' AS accepted FROM ("
        "SELECT r.request_id, r.caller_id, r.id, r.shop_id, r.role, concat_ws(';', "
        "CASE WHEN r.id IS NULL OR r.id IS DISTINCT FROM r.caller_id THEN 'not_own_profile' END, "
        "CASE WHEN r.role IS DISTINCT FROM 'owner' THEN 'role_not_owner' END, "
        "CASE WHEN s.id IS NULL THEN 'shop_not_owned' END) AS reasons "
        "FROM t_profile_requests r LEFT JOIN t_shops s ON s.id = r.shop_id AND s.owner_id = r.caller_id) x",
        "t_profile_requests",
        "t_shops",
    ),
)
def profiles_insert_check(t):
    """Profile inserts checked against shop ownership."""
    return TN.profile_insert_check(fx.profile_requests(t), fx.shops(t))


@query(
    "tenant_mismatch",
    with_tables(
        "SELECT r.request_id, r.caller_id, r.requested_shop_id, p.shop_id AS own_shop_id "
        "FROM t_tenant_requests r LEFT JOIN t_profiles p ON p.id = r.caller_id "
        "WHERE r.requested_shop_id IS NULL OR r.requested_shop_id IS DISTINCT FROM p.shop_id",
        "t_tenant_requests",
        "t_profiles",
    ),
)
def tenant_mismatch(t):
    """Writes aimed at a shop other than the caller's (null-safe)."""
    return TN.tenant_mismatch(fx.tenant_requests(t), fx.profiles(t))


@query(
    "shop_delete_restricted",
    with_tables(
        "SELECT s.id AS shop_id, NOT EXISTS (SELECT 1 FROM t_profiles p WHERE p.shop_id = s.id) AS accepted "
        "FROM t_shops s",
        "t_shops",
        "t_profiles",
    ),
)
def shop_delete_restricted(t):
    """Shop deletes blocked while a profile references the shop."""
    return TN.shop_delete_check(fx.shop_delete_requests(t), fx.profiles(t))
