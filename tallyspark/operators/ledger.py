"""Guarded ledger operators: snapshot + batch of commands → outcomes / new snapshot.

The reference applies one command per transaction.  Here a whole batch is
applied at once with a total order per key (``command_date, id``); the
result equals applying the commands one after the other.  Validation rules
(V*) come first, every violated rule is reported; then joins (M1-M3, M5,
M6, M8) or the greedy fold (M4, M7, M9).

New ids follow the largest existing id without gaps, in the order of the accepted
commands' unique sequence numbers, as an auto-increment column would give them
(``order.numbered``: ranks from the sizes of range partitions, no window over the batch).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import blank_to_null, is_blank, money, name_key, reasons, strip, to_double, violated
from ..schemas import MONEY
from ..sources.sinks import rewrite_buckets
from .fold import ADD, SKIP, TAKE, greedy_fold
from .order import connected, marked, numbered, stored

ACCEPTED = "accepted"
REJECTED = "rejected"


def _status(ok: Column) -> Column:
    return F.when(ok, F.lit(ACCEPTED)).otherwise(F.lit(REJECTED))


def _with_new_ids(existing: DataFrame, rows: DataFrame, name: str, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """``rows`` with the ids after the largest of ``existing``, in the order of ``seq_col``."""
    top = existing.select(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()
    return numbered(rows, [seq_col], name).withColumn(name, F.col(name) + top)


def _cents(c: str | Column) -> Column:
    return (money(c) * 100).cast("long")


def _from_cents(c: str | Column) -> Column:
    return (F.col(c).cast("decimal(20,0)") / F.lit(100)).cast(MONEY) if isinstance(c, str) else (
        c.cast("decimal(20,0)") / F.lit(100)
    ).cast(MONEY)


# ---------------------------------------------------------------- products (M1-M3)


def validate_products(requests: DataFrame) -> DataFrame:
    """V1: all violated rules per requested product row; a missing number violates its rule."""
    r = reasons(
        (is_blank("name"), "name_required"),
        (is_blank("category"), "category_required"),
        (violated((F.col("buy_price") < 0) | (F.col("sell_price") < 0)), "negative_price"),
        (violated((F.col("stock_quantity") < 0) | (F.col("low_stock_threshold") < 0)), "negative_stock"),
    )
    return requests.withColumn("reasons", F.array_join(r, ";")).withColumn("accepted", F.col("reasons") == "")


def _insert_check(products: DataFrame, requests: DataFrame) -> DataFrame:
    """V1 + V2 on an insert batch: the rule-valid requests (all their columns)
    with ``reason`` ('' = accepted): a name already used in the shop (any
    case) or repeated within the batch (the lowest ``seq`` keeps it)."""
    v = validate_products(requests).where(F.col("accepted")).drop("reasons", "accepted")
    v = v.withColumn("_nk", name_key("name"))
    taken = products.select("shop_id", name_key("name").alias("_nk")).distinct().withColumn("_taken", F.lit(True))
    v = v.join(taken, ["shop_id", "_nk"], "left")
    firsts = v.where(F.col("_taken").isNull()).groupBy("shop_id", "_nk").agg(F.min("seq").alias("_first"))
    v = v.join(firsts, ["shop_id", "_nk"], "left")
    reason = (
        F.when(F.col("_taken").isNotNull(), F.lit("duplicate_name"))
        .when(F.col("seq") != F.col("_first"), F.lit("duplicate_in_batch"))
        .otherwise(F.lit(""))
    )
    return v.withColumn("reason", reason).drop("_nk", "_taken", "_first")


def duplicate_products(products: DataFrame, requests: DataFrame) -> DataFrame:
    """V2: among rule-valid inserts, names already used in the shop (any case)
    or repeated within the batch (the lowest ``seq`` keeps the name)."""
    c = _insert_check(products, requests)
    return c.select("shop_id", "seq", "name", "reason", (F.col("reason") == "").alias("accepted"))


def insert_products(products: DataFrame, requests: DataFrame) -> DataFrame:
    """M1: the accepted inserts as product rows with new ids (trimmed text).
    The checked rows carry every request column, so the batch is not re-read."""
    rows = _insert_check(products, requests).where(F.col("reason") == "")
    return _with_new_ids(products, rows, "_id").select(
        "shop_id",
        F.col("_id").alias("id"),
        strip("name").alias("name"),
        strip("category").alias("category"),
        money("buy_price").alias("buy_price"),
        money("sell_price").alias("sell_price"),
        F.col("stock_quantity").cast("int").alias("stock_quantity"),
        F.col("low_stock_threshold").cast("int").alias("low_stock_threshold"),
    )


UPDATE_FIELDS = ["name", "category", "buy_price", "sell_price", "stock_quantity", "low_stock_threshold"]


def _rename_walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replays the commands of each group in order (rows sorted by group, rank, date, command id).

    Rank 0 rows say who holds a name before the batch, rank 1 rows are
    commands; the state is the names of the current group.  Yields the commands that ask for a name
    that another product has, or for an unknown product.
    """
    group, holders, held = None, {}, {}
    for batch in batches:
        found = []
        columns = (batch[c].tolist() for c in ("_group", "_rank", "shop_id", "id", "_nk", "_valid", "_known", "_at"))
        for g, rank, shop, product, key, valid, known, at in zip(*columns):
            if g != group:
                group, holders, held = g, {}, {}
            product, name = (shop, product), (shop, key)
            clash = False
            if rank:
                others = holders.get(name)
                clash = bool(others) and (len(others) > 1 or product not in others)
                if valid and not clash:
                    holders.get(held.get(product), set()).discard(product)
                if clash or not known:
                    found.append((at, clash, not known))
            if not rank or (valid and not clash):
                holders.setdefault(name, set()).add(product)
                held[product] = name
        yield pd.DataFrame(found, columns=["_at", "_taken", "_unknown"]).astype({"_at": "int64", "_taken": bool, "_unknown": bool})


def _name_groups(held: DataFrame) -> DataFrame:
    """The group of every name (_node, _group) that a moving product has or may get, from who may hold which (_node, _product).

    Names that one product links belong to one group.  Only names of several products link any, so
    each product's are chained to its first one, and the chains are few where the names are.
    """
    shared = held.groupBy("_node").agg(F.min("_product").alias("a"), F.max("_product").alias("b")).where("a < b").select("_node")
    shared = stored(held.join(shared, "_node", "left_semi"), "names")
    firsts = stored(shared.groupBy("_product").agg(F.min("_node").alias("_first")), "names")
    chains = shared.join(firsts, "_product").where("_node <> _first").select(F.col("_first").alias("a"), F.col("_node").alias("b")).distinct()
    firsts = firsts.join(connected(chains), F.col("_first") == F.col("node"), "left")
    firsts = firsts.select("_product", F.coalesce("group", "_first").alias("_group"))
    groups = held.join(firsts, "_product", "left")  # a product whose names are all its own is a group
    return groups.groupBy("_node").agg(F.min(F.coalesce("_group", "_product")).alias("_group"))


def update_outcomes(products: DataFrame, updates: DataFrame, carry: Sequence[str] | None = None, written: bool = False) -> DataFrame:
    """M2 per command: unknown id, rule violations, or a name that another product
    of the shop uses at that moment.  ``carry``: the columns of the commands that the result has, if not all;
    ``written``: the verdicts are written, too, for a result that is read several times.

    Commands count in order (date, command id).  Names that need the order are those that a moving
    product has or is moved to.  Such names that one product links
    (it has one and is moved to the other) belong to one group; any other name is a group of its own.
    Each group is replayed in order, on its own, with its names as state, so a shop with very many renames is spread over
    as many tasks as it has groups.  A command by the only product that may ever hold its name cannot clash and is left
    out, unless it moves the product.  What a command carries besides its name is written once and not dealt out:
    the verdicts come back by its position.  Building the plan runs the jobs that find the groups.
    """
    carry = list(updates.columns if carry is None else carry)
    key, ids = name_key("name"), ["shop_id", "id"]
    own = products.select(*ids, name_key("name").alias("_own"), F.lit(True).alias("_known"))
    needed = list(dict.fromkeys([*carry, *ids, "name", "command_date", "command_id"]))
    u = stored(validate_products(updates).select(*needed, "reasons", F.monotonically_increasing_id().alias("_at")), "updates")
    ok, known = F.col("reasons") == "", F.coalesce("_known", F.lit(False))
    asked = u.groupBy(*ids, key.alias("_nk")).agg(F.max(ok).alias("_ok")).join(own, ids, "left")
    moves = F.col("_ok") & known & ~F.col("_nk").eqNullSafe(F.col("_own"))
    asked = stored(asked.select(*ids, "_nk", (F.col("_ok") & known).alias("_valid"), known.alias("_known"), moves.alias("_moves")), "asked")
    # a node is the hash of a name or a product: should two be equal, their groups are replayed as one
    node, product = F.xxhash64("shop_id", "_nk").alias("_node"), F.xxhash64(*ids, F.lit("product")).alias("_product")
    named = own.where("_own is not null and shop_id is not null and id is not null").select(*ids, F.col("_own").alias("_nk"))
    held = asked.where("_valid").select(*ids, node).unionByName(named.select(*ids, node)).distinct()
    movers = asked.where("_moves").select(*ids).distinct().withColumn("_mover", F.lit(True))
    held = stored(held.join(movers, ids, "left").select(*ids, "_node", product, F.col("_mover").isNotNull().alias("_mover")), "held")
    groups = _name_groups(held.where("_mover").select("_node", "_product"))
    only = held.groupBy("_node").agg(F.min(F.struct(*ids)).alias("_least"), F.max(F.struct(*ids)).alias("_last"))
    names = stored(only.join(groups, "_node", "left"), "names")
    a = asked.withColumn("_node", node).join(names, "_node", "left")
    mine = (F.col("_least") == F.col("_last")) & (F.col("_least") == F.struct(*ids))
    silent = F.col("_least").isNull() | F.coalesce(mine, F.lit(False))  # nobody else ever has the name
    walks = ~silent | (F.col("_valid") & F.col("_group").isNotNull())
    a = a.where(walks | ~F.col("_known"))
    a = a.where("shop_id is not null and id is not null").select(*[F.col(c).alias(f"_a_{c}") for c in ids], F.col("_nk").alias("_a_nk"), "_known", F.coalesce("_group", "_node").alias("_group"))
    a = stored(a, "asked")
    same = (F.col("shop_id") == F.col("_a_shop_id")) & (F.col("id") == F.col("_a_id")) & F.col("_nk").eqNullSafe(F.col("_a_nk"))
    rows = u.select("_at", *ids, key.alias("_nk"), "command_date", "command_id", ok.alias("_ok")).join(a, same)
    rows = rows.select("_group", F.lit(1).alias("_rank"), "command_date", "command_id", *ids, "_nk", (F.col("_ok") & F.col("_known")).alias("_valid"), "_known", "_at")
    opening = named.withColumn("_node", node).join(names.select("_node", "_group"), "_node", "left").select(
        F.coalesce("_group", "_node").alias("_group"), F.lit(0).alias("_rank"), *ids, "_nk", F.lit(True).alias("_valid"), F.lit(True).alias("_known"), F.lit(-1).cast("long").alias("_at")
    )
    rows = rows.unionByName(stored(opening, "opening"), allowMissingColumns=True)
    # a repartition on an expression is never dropped as redundant
    rows = rows.repartition(F.xxhash64("_group")).sortWithinPartitions("_group", "_rank", "command_date", "command_id")
    walked = rows.drop("command_date", "command_id").mapInPandas(_rename_walk, "_at long, _taken boolean, _unknown boolean")
    u = marked(u, "_at", stored(walked, "verdicts") if written else walked, "_unknown", "_taken")
    nobody = F.col("_unknown") | F.col("shop_id").isNull() | F.col("id").isNull()  # a missing shop or id is nobody's
    allr = F.concat_ws(
        ";",
        F.nullif(F.col("reasons"), F.lit("")),
        F.when(nobody, F.lit("not_found")),
        F.when(F.col("_taken"), F.lit("duplicate_name")),
    )
    return u.withColumn("reasons", allr).withColumn("accepted", F.col("reasons") == "").select(*carry, "reasons", "accepted")


def update_products(products: DataFrame, updates: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """M2: new snapshot; per product the last accepted command (by date, id) wins.  ``outcomes``: those of
    the same updates, if they are there already."""
    ok = (update_outcomes(products, updates) if outcomes is None else outcomes).where(F.col("accepted"))
    last = ok.groupBy("shop_id", "id").agg(
        F.max(F.struct("command_date", "command_id", *[F.col(c).alias(f"n_{c}") for c in UPDATE_FIELDS])).alias("u")
    )
    j = products.join(last, ["shop_id", "id"], "left")
    out = [F.coalesce(strip(F.col(f"u.n_{c}")) if c in ("name", "category") else F.col(f"u.n_{c}"), F.col(c)).alias(c)
           for c in UPDATE_FIELDS]
    return j.select("shop_id", "id", *out).select(
        "shop_id", "id", "name", "category",
        money("buy_price").alias("buy_price"), money("sell_price").alias("sell_price"),
        F.col("stock_quantity").cast("int").alias("stock_quantity"),
        F.col("low_stock_threshold").cast("int").alias("low_stock_threshold"),
    )


def accepted_deletes(table: DataFrame, deletes: DataFrame, key: str = "id") -> DataFrame:
    """Delete requests whose target exists (unknown ids are the reject side)."""
    return deletes.select("shop_id", key).join(table.select("shop_id", key), ["shop_id", key], "left_semi").distinct()


def delete_outcomes(table: DataFrame, deletes: DataFrame, key: str = "id") -> DataFrame:
    """M3 per request: accepted, or rejected because nothing has that id in the shop."""
    known = table.select("shop_id", key).distinct().withColumn("_known", F.lit(True))
    j = deletes.select("shop_id", key).distinct().join(known, ["shop_id", key], "left")
    ok = F.col("_known").isNotNull()
    return j.select("shop_id", key, _status(ok).alias("status"), F.when(ok, F.lit("")).otherwise(F.lit("not_found")).alias("reason"))


def delete_products(products: DataFrame, deletes: DataFrame) -> DataFrame:
    """M3: products without the deleted ones."""
    return products.join(deletes.select("shop_id", "id"), ["shop_id", "id"], "left_anti")


def null_deleted_refs(ledger: DataFrame, products: DataFrame, deletes: DataFrame, ref: str = "product_id") -> DataFrame:
    """M3 (ON DELETE SET NULL): ledger rows keep their names, lose the product id."""
    return _null_refs(ledger, accepted_deletes(products, deletes), ref)


def _null_refs(ledger: DataFrame, gone: DataFrame, ref: str) -> DataFrame:
    gone = gone.select("shop_id", F.col("id").alias(ref)).withColumn("_gone", F.lit(True))
    j = ledger.join(gone, ["shop_id", ref], "left")
    return j.withColumn(ref, F.when(F.col("_gone").isNull(), F.col(ref))).drop("_gone").select(*ledger.columns)


def null_refs_stored(spark, path: str, schema, products: DataFrame, deletes: DataFrame, order: list[str], ref: str = "product_id") -> dict:
    """M3 on a ledger written by ``sinks.write_buckets``: a new version in which only the buckets of the shops
    with a deleted product are rewritten."""
    gone = stored(accepted_deletes(products, deletes), "deletes")
    return _rewrite(spark, path, schema, gone, lambda rows, gone: _null_refs(rows, gone, ref), order)


def cascade_customers_stored(spark, path: str, schema, deletes: DataFrame, order: list[str]) -> dict:
    """M3b on a ledger written by ``sinks.write_buckets``: likewise for the rows of deleted customers."""
    gone = stored(deletes.select("shop_id", "id").distinct(), "deletes")
    return _rewrite(spark, path, schema, gone, lambda rows, gone: cascade_customer_delete(rows, gone).select(*schema.names), order)


FEW_KEYS = 1_000_000  # deleted keys that every task may hold


def _rewrite(spark, path, schema, gone: DataFrame, change, order: list[str]) -> dict:
    """``rewrite_buckets`` by the deleted keys: where they are few, rows are changed where they lie, and not dealt out again."""
    few = gone.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    known = F.broadcast(gone) if few else gone
    return rewrite_buckets(spark, path, schema, gone.select("shop_id"), lambda rows: change(rows, known), order, placed=few)


def cascade_customer_delete(debts: DataFrame, deletes: DataFrame) -> DataFrame:
    """Ledger rows of deleted customers disappear with them."""
    return debts.join(deletes.select("shop_id", F.col("id").alias("customer_id")), ["shop_id", "customer_id"], "left_anti")


def cascade_shop_delete(tables: dict[str, DataFrame], deletes: DataFrame) -> dict[str, DataFrame]:
    """Every business table without the rows of the deleted shops."""
    gone = deletes.select("shop_id").distinct()
    return {name: df.join(gone, "shop_id", "left_anti") for name, df in tables.items()}


# ---------------------------------------------------------------- sales (M4)


def _with_product(commands: DataFrame, products: DataFrame) -> DataFrame:
    p = products.select(
        F.col("shop_id").alias("_p_shop"),
        F.col("id").alias("_p_id"),
        F.col("name").alias("product_name"),
        "buy_price",
        "sell_price",
        "stock_quantity",
    )
    return commands.join(
        p, (F.col("shop_id") == F.col("_p_shop")) & (F.col("product_id") == F.col("_p_id")), "left"
    )


def validate_sales(products: DataFrame, commands: DataFrame) -> DataFrame:
    """V3: quantity > 0 and the product exists."""
    j = _with_product(commands, products)
    r = reasons(
        (F.coalesce(F.col("quantity"), F.lit(0)) <= 0, "quantity_not_positive"),
        (F.col("_p_id").isNull(), "product_not_found"),
    )
    return j.select(
        *commands.columns, F.array_join(r, ";").alias("reasons")
    ).withColumn("accepted", F.col("reasons") == "")


SALE_OUT = ["shop_id", "id", "product_id", "product_name", "quantity", "sale_date", "status", "reason", "revenue", "profit"]


def apply_sales(products: DataFrame, commands: DataFrame) -> DataFrame:
    """M4: record a batch of sales; a sale that does not fit the stock left by
    the earlier accepted sales of its product is rejected and takes nothing.
    Invalid requests ride through the same pass as skipped rows."""
    j = _with_product(commands, products)
    r = F.array_join(
        reasons(
            (F.coalesce(F.col("quantity"), F.lit(0)) <= 0, "quantity_not_positive"),
            (F.col("_p_id").isNull(), "product_not_found"),
        ),
        ";",
    )
    cmds = j.select(
        "shop_id", "product_id", "id", "command_date", "quantity", "product_name", "buy_price", "sell_price",
        r.alias("_reasons"),
        F.when(r == "", F.lit(TAKE)).otherwise(F.lit(SKIP)).alias("_kind"),
        F.coalesce(F.col("quantity").cast("long"), F.lit(0)).alias("_amount"),
        F.coalesce(F.col("stock_quantity").cast("long"), F.lit(0)).alias("_opening"),
    )
    f = greedy_fold(cmds, ["shop_id", "product_id"], ["command_date", "id"], spread="id")
    ok = F.col("accepted")
    return f.select(
        "shop_id", "id", "product_id", "product_name", "quantity", F.col("command_date").alias("sale_date"),
        _status(ok).alias("status"),
        F.when(ok, F.lit("")).when(F.col("_kind") == SKIP, F.col("_reasons"))
        .otherwise(F.lit("insufficient_stock")).alias("reason"),
        F.when(ok, to_double(F.col("sell_price") * F.col("quantity"))).alias("revenue"),
        F.when(ok, to_double((F.col("sell_price") - F.col("buy_price")) * F.col("quantity"))).alias("profit"),
    )


def stock_after(products: DataFrame, moved: DataFrame, sign: int) -> DataFrame:
    """Products with ``stock + sign·Σ units`` of ``moved(shop_id, product_id, units)``."""
    m = moved.groupBy("shop_id", F.col("product_id").alias("id")).agg(F.sum("units").alias("_units"))
    j = products.join(m, ["shop_id", "id"], "left")
    return j.select(
        "shop_id", "id", "name", "category", "buy_price", "sell_price",
        (F.col("stock_quantity") + F.lit(sign) * F.coalesce(F.col("_units"), F.lit(0))).cast("int").alias("stock_quantity"),
        "low_stock_threshold",
    )


def apply_sales_stock(products: DataFrame, commands: DataFrame) -> DataFrame:
    """M4: the product snapshot after the batch."""
    sold = apply_sales(products, commands).where(F.col("status") == ACCEPTED).select(
        "shop_id", "product_id", F.col("quantity").alias("units")
    )
    return stock_after(products, sold, -1)


# ---------------------------------------------------------------- restocks (M6)


def validate_restocks(products: DataFrame, commands: DataFrame) -> DataFrame:
    """V6: quantity > 0, supplier given, price ≥ 0, product exists."""
    j = _with_product(commands, products)
    r = reasons(
        (F.coalesce(F.col("quantity"), F.lit(0)) <= 0, "quantity_not_positive"),
        (is_blank("supplier_name"), "supplier_required"),
        (violated(F.col("unit_buy_price") < 0), "negative_price"),
        (F.col("_p_id").isNull(), "product_not_found"),
    )
    return j.select(*commands.columns, "product_name", F.array_join(r, ";").alias("reasons")).withColumn(
        "accepted", F.col("reasons") == ""
    )


def apply_restocks(products: DataFrame, commands: DataFrame) -> DataFrame:
    """M6: ledger rows of the accepted restocks (name snapshot, trimmed supplier)."""
    v = validate_restocks(products, commands).where(F.col("accepted"))
    return v.select(
        "shop_id",
        "id",
        "product_id",
        "product_name",
        F.col("quantity").alias("quantity_added"),
        strip("supplier_name").alias("supplier_name"),
        money("unit_buy_price").alias("unit_buy_price"),
        F.col("command_date").alias("restock_date"),
        F.col("update_buy_price").alias("updated_buy_price"),
    )


def apply_restocks_stock(products: DataFrame, commands: DataFrame) -> DataFrame:
    """M6: stock += Σ quantity; buy price = the last price-updating restock (by date, id).

    The row rules of V6 are applied before aggregating; "product exists" needs
    no join of its own, since restocks of unknown products find no row in the
    final products join.  One join with the products, after the batch is
    reduced to one row per product.
    """
    ok = commands.where(
        (F.coalesce(F.col("quantity"), F.lit(0)) > 0)
        & ~is_blank("supplier_name")
        & ~violated(F.col("unit_buy_price") < 0)
    )
    agg = ok.groupBy("shop_id", F.col("product_id").alias("id")).agg(
        F.sum("quantity").alias("_units"),
        F.max(
            F.when(F.col("update_buy_price"), F.struct("command_date", "id", money("unit_buy_price").alias("unit_buy_price")))
        ).alias("_last"),
    )
    j = products.join(agg, ["shop_id", "id"], "left")
    return j.select(
        "shop_id", "id", "name", "category",
        F.coalesce(F.col("_last.unit_buy_price"), F.col("buy_price")).alias("buy_price"),
        "sell_price",
        (F.col("stock_quantity") + F.coalesce(F.col("_units"), F.lit(0))).cast("int").alias("stock_quantity"),
        "low_stock_threshold",
    )


# ---------------------------------------------------------------- timeline (M9)


def _timeline(products: DataFrame, sales: DataFrame, restocks: DataFrame, named: bool) -> DataFrame:
    """Sales (``_rank`` 1) and restocks (0) on one timeline per product, folded.  A sale sees the
    stock and the buy price left by every earlier command (restocks first on ties).

    Each command is validated by its kind's rules (V3 for sales, V6 for restocks) where it is read, so that only the
    verdict travels; both kinds are unioned and joined to the products once, by a join that leaves the commands of
    a product together, so that the fold needs no shuffle of its own; invalid rows ride through it as skips.  With ``named``, sales carry the product's name and
    price and whether it is missing.
    """
    few = F.coalesce(F.col("quantity"), F.lit(0)) <= 0
    own = ["shop_id", "product_id", "id", "command_date", "quantity"]
    bad = few | is_blank("supplier_name") | violated(F.col("unit_buy_price") < 0)
    s = sales.select(*own, F.lit(1).alias("_rank"), few.alias("_bad"), F.lit(None).cast("long").alias("_mark"))
    r = restocks.select(
        *own, F.lit(0).alias("_rank"), bad.alias("_bad"), F.when(~bad & F.col("update_buy_price"), _cents("unit_buy_price")).alias("_mark")
    )
    j = _with_product(s.unionByName(r), products.hint("shuffle_hash"))
    is_sale, missing = F.col("_rank") == 1, F.col("_p_id").isNull()
    details = [F.when(is_sale, F.col(c)).alias(c) for c in ("product_name", "sell_price")] + [missing.alias("_missing")]
    cmds = j.select(
        *own, "_rank", *(details if named else []),
        F.when(F.col("_bad") | missing, F.lit(SKIP)).when(is_sale, F.lit(TAKE)).otherwise(F.lit(ADD)).alias("_kind"),
        F.when(~missing, F.col("_mark")).alias("_mark"),
        F.coalesce(F.col("quantity").cast("long"), F.lit(0)).alias("_amount"),
        F.coalesce(F.col("stock_quantity").cast("long"), F.lit(0)).alias("_opening"),
        _cents("buy_price").alias("_opening_mark"),
    )
    return greedy_fold(cmds, ["shop_id", "product_id"], ["command_date", "id", "_rank"], mark=True, spread="id", clustered=True)


def apply_stock_timeline(products: DataFrame, sales: DataFrame, restocks: DataFrame) -> DataFrame:
    """M9: the sale rows of the timeline, with the product's name and the profit at the buy price of the moment.
    The restock rows are those of ``apply_restocks``: no rule of theirs depends on the order."""
    sold = _timeline(products, sales, restocks, named=True).where(F.col("_rank") == 1)
    ok = F.col("accepted")
    buy = _from_cents(F.col("mark_at"))
    broken = reasons((F.coalesce(F.col("quantity"), F.lit(0)) <= 0, "quantity_not_positive"), (F.col("_missing"), "product_not_found"))
    return sold.select(
        "shop_id", "id", "product_id", "product_name", "quantity", F.col("command_date").alias("sale_date"),
        _status(ok).alias("status"),
        F.when(ok, F.lit("")).when(F.col("_kind") == SKIP, F.array_join(broken, ";"))
        .otherwise(F.lit("insufficient_stock")).alias("reason"),
        F.when(ok, to_double(F.col("sell_price") * F.col("quantity"))).alias("revenue"),
        F.when(ok, to_double((F.col("sell_price") - buy) * F.col("quantity"))).alias("profit"),
    )


def timeline_stock(products: DataFrame, sales: DataFrame, restocks: DataFrame) -> DataFrame:
    """M9: the product snapshot after the timeline: stock moved by every accepted command, the last buy price."""
    done = _timeline(products, sales, restocks, named=False).where(F.col("accepted"))
    signed = F.when(F.col("_rank") == 1, -F.col("quantity")).otherwise(F.col("quantity"))
    moved = done.groupBy("shop_id", F.col("product_id").alias("id")).agg(
        F.sum(signed).alias("_units"), F.max(F.struct("command_date", "id", "_rank", "mark_at")).alias("_last")
    )
    j = products.join(moved, ["shop_id", "id"], "left")
    return j.select(
        "shop_id", "id", "name", "category",
        F.coalesce(_from_cents(F.col("_last.mark_at")), F.col("buy_price")).alias("buy_price"),
        "sell_price",
        (F.col("stock_quantity") + F.coalesce(F.col("_units"), F.lit(0))).cast("int").alias("stock_quantity"),
        "low_stock_threshold",
    )


# ---------------------------------------------------------------- customers (M5, M7)


def validate_debts(commands: DataFrame) -> DataFrame:
    """V4 (+V9): name given, amount > 0 *after* rounding to cents."""
    r = reasons(
        (is_blank("customer_name"), "name_required"),
        (F.coalesce(money("amount"), F.lit(0)) <= 0, "amount_not_positive"),
    )
    return commands.withColumn("reasons", F.array_join(r, ";")).withColumn("accepted", F.col("reasons") == "")


def _customer_keys(customers: DataFrame) -> DataFrame:
    return customers.groupBy("shop_id", name_key("name").alias("_nk")).agg(F.min("id").alias("_cid"))


def upsert_customers(customers: DataFrame, commands: DataFrame) -> DataFrame:
    """M5: customers after a batch of debts: unknown names are created (first
    spelling by seq wins), a non-blank phone overwrites (last by seq wins).

    One full outer join of the customers with the batch's per-name summary, written once,
    yields both the updated and the new rows, so the batch is aggregated once.
    """
    v = validate_debts(commands).where(F.col("accepted")).withColumn("_nk", name_key("customer_name"))
    per_name = v.groupBy("shop_id", "_nk").agg(
        F.min(F.struct("seq", strip("customer_name").alias("n"))).alias("_first"),
        F.max(F.when(~is_blank("phone"), F.struct("seq", strip("phone").alias("ph")))).alias("_phone"),
    )
    # The phone goes to the lowest id among customers sharing the name key.
    c = customers.withColumn("_nk", name_key("name")).join(_customer_keys(customers), ["shop_id", "_nk"], "left")
    j = stored(c.join(per_name, ["shop_id", "_nk"], "full"), "upsert")
    new_phone = F.when(F.col("id") == F.col("_cid"), F.col("_phone.ph"))
    known = j.where(F.col("id").isNotNull()).select("shop_id", "id", "name", F.coalesce(new_phone, F.col("phone")).alias("phone"))
    new = j.where(F.col("id").isNull()).select(
        "shop_id", F.col("_first.seq").alias("seq"), F.col("_first.n").alias("name"), F.col("_phone.ph").alias("phone")
    )
    return known.unionByName(_with_new_ids(customers, new, "id").select("shop_id", "id", "name", "phone"))


def phone_updates(customers: DataFrame, commands: DataFrame) -> DataFrame:
    """The customers (shop_id, id) whose phone a batch of debts sets, to whatever value."""
    v = validate_debts(commands).where(F.col("accepted") & ~is_blank("phone"))
    names = v.select("shop_id", name_key("customer_name").alias("_nk")).distinct()
    return _customer_keys(customers).join(names, ["shop_id", "_nk"]).select("shop_id", F.col("_cid").alias("id"))


def apply_debts(customers: DataFrame, commands: DataFrame) -> DataFrame:
    """M5: debt ledger rows for the batch, customer id resolved by name
    (case-insensitive); the row keeps the name as typed (trimmed)."""
    after = upsert_customers(customers, commands)
    keys = _customer_keys(after)
    v = validate_debts(commands).withColumn("_nk", name_key("customer_name"))
    j = v.join(keys, ["shop_id", "_nk"], "left")
    return j.select(
        "shop_id",
        F.col("seq").alias("id"),
        F.when(F.col("accepted"), F.col("_cid")).alias("customer_id"),
        strip("customer_name").alias("customer_name"),
        F.lit("debt").alias("transaction_type"),
        to_double(money("amount")).alias("amount"),
        blank_to_null("note").alias("note"),
        F.col("command_date").alias("transaction_date"),
        _status(F.col("accepted")).alias("status"),
        F.col("reasons").alias("reason"),
    )


LEDGER_TYPES = ("debt", "payment")
PAYMENT_NOTE = "Customer payment"


def signed_amount(amount: Column, kind: Column) -> Column:
    """What a ledger row adds to the balance; null for a type outside the domain."""
    return F.when(kind == "debt", amount).when(kind == "payment", -amount)


def _with_customer(customers: DataFrame, rows: DataFrame) -> DataFrame:
    c = customers.select("shop_id", F.col("id").alias("customer_id"), F.col("name").alias("_name"))
    return rows.join(c.withColumn("_known", F.lit(True)), ["shop_id", "customer_id"], "left")


def _payment_reasons() -> Column:
    return F.array_join(
        reasons(
            (violated(~F.col("transaction_type").isin(*LEDGER_TYPES)), "unknown_type"),
            (F.coalesce(money("amount"), F.lit(0)) <= 0, "amount_not_positive"),
            (F.col("_known").isNull(), "customer_not_found"),
        ),
        ";",
    )


def validate_payments(customers: DataFrame, payments: DataFrame) -> DataFrame:
    """V4 (type domain) and V5: amount > 0 after rounding, customer exists."""
    j = _with_customer(customers, payments).withColumn("reasons", _payment_reasons())
    return j.select(*payments.columns, "reasons").withColumn("accepted", F.col("reasons") == "")


def apply_payments(customers: DataFrame, ledger: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """M7: replay debt and payment commands per customer; a payment larger than
    the balance left by the earlier accepted rows is rejected.

    The guard compares the amount as given; the ledger row holds it rounded.
    A payment's row carries the customer's name and a fixed note, a debt's row the
    name and note of the command, where given.  ``opening(shop_id, customer_id,
    balance)`` is the balance before the batch (absent → 0).  Invalid rows ride
    through the same pass as skipped rows.
    """
    has = set(ledger.columns)
    v = _with_customer(customers, ledger).withColumn("reasons", _payment_reasons())
    if opening is not None:
        v = v.join(opening.select("shop_id", "customer_id", (F.col("balance") * 100).cast("long").alias("_open")),
                   ["shop_id", "customer_id"], "left")
    else:
        v = v.withColumn("_open", F.lit(0).cast("long"))
    pays = F.coalesce(F.col("transaction_type") == "payment", F.lit(False))
    typed = F.coalesce(strip("customer_name"), F.col("_name")) if "customer_name" in has else F.col("_name")
    note = blank_to_null("note") if "note" in has else F.lit(None).cast("string")
    kind = F.when(F.col("reasons") != "", F.lit(SKIP)).when(pays, F.lit(TAKE)).otherwise(F.lit(ADD))
    cents = F.coalesce(_cents("amount"), F.lit(0))
    # an amount that was rounded down needs one cent more than it takes
    asked = F.ceil(F.col("amount").cast("decimal(38,6)") * 100).cast("long")
    good = v.select(
        "shop_id", "customer_id", "id", "transaction_type", "amount", "transaction_date", "reasons",
        F.when(pays, F.col("_name")).otherwise(typed).alias("customer_name"),
        F.when(pays, F.lit(PAYMENT_NOTE)).otherwise(note).alias("note"),
        kind.alias("_kind"),
        cents.alias("_amount"),
        F.greatest(F.coalesce(asked, F.lit(0)) - cents, F.lit(0)).cast("long").alias("_extra"),
        F.coalesce("_open", F.lit(0)).cast("long").alias("_opening"),
    )
    f = greedy_fold(good, ["shop_id", "customer_id"], ["transaction_date", "id"], spread="id")
    ok = F.col("accepted")
    return f.select(
        "shop_id", "id", "customer_id", "customer_name", "transaction_type", to_double(money("amount")).alias("amount"),
        "note", "transaction_date", _status(ok).alias("status"),
        F.when(ok, F.lit("")).when(F.col("_kind") == SKIP, F.col("reasons"))
        .otherwise(F.lit("exceeds_balance")).alias("reason"),
    )


# ---------------------------------------------------------------- onboarding (M8)


def onboard_shops(shops: DataFrame, profiles: DataFrame, requests: DataFrame) -> DataFrame:
    """M8: shop + owner profile per sign-up; blank shop names and users who
    already have a profile are rejected; a user's first request by seq wins."""
    from .tenant import onboarding_check

    c = onboarding_check(requests, profiles)
    firsts = c.where(F.col("reasons") == "").groupBy("user_id").agg(F.min("seq").alias("_first"))
    c = c.join(firsts, "user_id", "left")
    reason = F.when(F.col("reasons") != "", F.col("reasons")).when(
        F.col("seq") != F.col("_first"), F.lit("already_has_shop")
    ).otherwise(F.lit(""))
    c = stored(c.withColumn("reason", reason), "onboarding")
    ok = F.col("reason") == ""
    ids = _with_new_ids(shops, c.where(ok).select("seq"), "_id")
    return c.join(ids, "seq", "left").select(
        "user_id",
        "seq",
        _status(ok).alias("status"),
        "reason",
        F.when(ok, F.col("_id")).alias("shop_id"),
        F.when(ok, strip("shop_name")).alias("shop_name"),
        F.when(ok, blank_to_null("full_name")).alias("full_name"),
        F.when(ok, F.lit("owner")).alias("role"),
    )
