"""Request and table rules: split a batch into accepted and rejected rows.

A rejected row carries ``errors`` = ``field: message, field: message`` of all
failing rules (as a validation response lists them). Rules are native
predicates; per-order verdicts over items are a partially aggregated
``bool_and``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.expr import error_list, not_blank

# --- fixed values: rule messages --------------------------------------------
NAME_REQUIRED = "name: name is required"
SKU_REQUIRED = "sku: sku is required"
SKU_PATTERN_MSG = "sku: SKU must be 3-20 uppercase alphanumeric characters"
CATEGORY_REQUIRED = "category: category is required"
PRICE_REQUIRED = "price: price is required"
PRICE_POSITIVE = "price: price must be positive"
STOCK_NEGATIVE = "initialStock: initialStock cannot be negative"
DELTA_REQUIRED = "delta: delta is required"
NOT_NULL = "must not be null"
NOT_BLANK = "must not be blank"
NOT_EMPTY = "must not be empty"
ITEMS_EMPTY = "items: Order must have at least one item"


def _split(df: DataFrame, errors) -> DataFrame:
    return df.withColumn("errors", errors).withColumn("accepted", F.col("errors") == "")


# ------------------------------------------------------------------ V1
def validate_products(requests: DataFrame) -> DataFrame:
    """name, sku, category not blank; sku pattern; price present and > 0;
    initialStock >= 0."""
    sku = F.col("sku")
    return _split(requests, error_list(
        (~not_blank("name"), NAME_REQUIRED),
        (~not_blank("sku"), SKU_REQUIRED),
        (sku.isNotNull() & ~sku.rlike(C.SKU_PATTERN), SKU_PATTERN_MSG),
        (~not_blank("category"), CATEGORY_REQUIRED),
        (F.col("price").isNull(), PRICE_REQUIRED),
        (F.col("price") <= 0, PRICE_POSITIVE),
        (F.col("initial_stock") < 0, STOCK_NEGATIVE),
    ))


# ------------------------------------------------------------------ V2
def validate_stock_deltas(requests: DataFrame) -> DataFrame:
    return _split(requests, error_list((F.col("delta").isNull(), DELTA_REQUIRED)))


# ------------------------------------------------------------------ V3
def _item_rules() -> list[tuple[Column, str, str]]:
    """(fails, field, message) of an order item."""
    least = F.lit(0.01).cast("decimal(12,2)")
    return [(F.col("product_id").isNull(), "productId", NOT_NULL), (~not_blank("sku"), "sku", NOT_BLANK),
            (F.col("quantity") < 1, "quantity", "must be greater than or equal to 1"), (F.col("unit_price").isNull(), "unitPrice", NOT_NULL),
            (F.col("unit_price") < least, "unitPrice", "must be greater than or equal to 0.01")]


def validate_orders(orders: DataFrame, items: DataFrame, key: str = "order_id") -> DataFrame:
    """Per order: customerId present, at least one item, every item valid
    (productId present, sku not blank, quantity >= 1, unitPrice >= 0.01). What is wrong
    with items is told per field, with the number of items it holds for; the counts are
    added up before the shuffle, so an order of very many items needs no list."""
    rules = _item_rules()
    fails = [F.coalesce(cond, F.lit(False)) for cond, _, _ in rules]
    bad = fails[0]
    for f in fails[1:]:
        bad = bad | f
    per = items.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(bad).alias("n_bad_items"),
                                 *(F.count_if(f).alias(f"_bad{k}") for k, f in enumerate(fails)))
    counts = ["n_items", "n_bad_items", *(f"_bad{k}" for k in range(len(rules)))]
    o = orders.join(per, orders["id"] == per[key], "left").drop(key)
    o = o.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts})
    told = [F.when(F.col("customer_id").isNull(), f"customerId: {NOT_NULL}"), F.when(F.col("n_items") == 0, ITEMS_EMPTY)]
    told += [F.when(F.col(f"_bad{k}") > 0, F.format_string(f"items.{field}: {text} (%d)", F.col(f"_bad{k}"))) for k, (_, field, text) in enumerate(rules)]
    return _split(o, F.concat_ws(", ", *told)).drop(*(f"_bad{k}" for k in range(len(rules))))


def validate_order_items(items: DataFrame) -> DataFrame:
    """Per item: the field messages of its failing rules (productId not null,
    sku not blank, quantity >= 1, unitPrice present and >= 0.01). One row per
    item, so an order with very many items needs no per-order list."""
    return _split(items, error_list(*((cond, f"{field}: {text}") for cond, field, text in _item_rules())))


# ------------------------------------------------------------------ V4
def validate_forecast_requests(requests: DataFrame, history: DataFrame,
                               key: str = "product_id") -> DataFrame:
    """productId present, sku not blank, horizon 1..365, history not empty."""
    has = history.select(key).distinct().withColumn("_has", F.lit(True))
    r = requests.join(has, key, "left")
    return _split(r, error_list(
        (F.col(key).isNull(), f"productId: {NOT_NULL}"),
        (~not_blank("sku"), f"sku: {NOT_BLANK}"),
        (F.col("horizon_days") < C.MIN_HORIZON, "horizonDays: must be greater than or equal to 1"),
        (F.col("horizon_days") > C.MAX_HORIZON, "horizonDays: must be less than or equal to 365"),
        (F.col("_has").isNull(), f"historicalData: {NOT_EMPTY}"),
    )).drop("_has")


# ------------------------------------------------------------------ V6
def validate_points(points: DataFrame) -> DataFrame:
    return _split(points, error_list(
        (F.col("lower_bound") > F.col("upper_bound"), "lowerBound cannot exceed upperBound"),
        (F.col("predicted_quantity") < 0, "predictedQuantity cannot be negative"),
    ))


# ------------------------------------------------------------------ V7
#: Every rule of the stored tables: NOT NULL columns, lengths, checks (broken
#: when true; a null breaks NOT NULL only), unique keys (the first is the primary
#: key) and parents.
DDL = {
    "products": dict(
        not_null=("product_id", "name", "sku", "category", "price", "stock_quantity", "created_at", "updated_at", "version"),
        lengths={"name": 255, "sku": 50, "category": 100},
        checks={"price_non_negative": "price < 0", "stock_non_negative": "stock_quantity < 0"},
        unique=("product_id", "sku")),
    "orders": dict(
        not_null=("id", "customer_id", "status", "created_at", "updated_at", "version"), lengths={"status": 20},
        checks={"status_allowed": ("status", C.ORDER_STATUSES)}, unique=("id",)),
    "order_items": dict(
        not_null=("order_id", "product_id", "sku", "quantity", "unit_price"), lengths={"sku": 50},
        checks={"quantity_positive": "quantity <= 0", "unit_price_non_negative": "unit_price < 0"},
        parent=("order_fk", "order_id", "orders")),
    "forecast_jobs": dict(
        not_null=("id", "product_id", "sku", "horizon_days", "status", "created_at", "updated_at", "version"),
        lengths={"sku": 50, "status": 20, "model_used": 50, "error_message": 1000},
        checks={"status_allowed": ("status", C.JOB_STATUSES),
                "horizon_range": f"horizon_days NOT BETWEEN {C.MIN_HORIZON} AND {C.MAX_HORIZON}"}, unique=("id",)),
    "forecast_points": dict(
        not_null=("job_id", "forecast_date", "predicted_quantity", "lower_bound", "upper_bound"),
        checks={"predicted_non_negative": "predicted_quantity < 0"}, parent=("job_fk", "job_id", "forecast_jobs")),
    "alerts": dict(
        not_null=("id", "type", "severity", "product_id", "sku", "title", "message", "occurred_at"),
        lengths={"type": 30, "severity": 20, "product_id": 255, "sku": 50, "title": 255}, unique=("id",)),
}


def column_rules(table: str) -> dict[str, Column]:
    """The rules of a table that a row breaks by itself, true where broken."""
    ddl = DDL[table]
    rules = {f"{c}_not_null": F.col(c).isNull() for c in ddl["not_null"]}
    rules |= {f"{c}_length_{n}": F.length(F.col(c).cast("string")) > n for c, n in ddl.get("lengths", {}).items()}
    return rules | {name: F.expr(c) if isinstance(c, str) else ~F.col(c[0]).isin(*c[1]) for name, c in ddl.get("checks", {}).items()}


RULES, OWNER, CHILD = range(3)  # roles


def _spaces() -> list[str]:
    """What a key stands for: a table (its broken rules) or a unique column."""
    return [*DDL, *(f"{t}.{c}" for t, ddl in DDL.items() for c in ddl.get("unique", ()))]


def _tagged(table: str, df: DataFrame) -> DataFrame:
    """What a table's rows say: (space, key, role). A broken row says which rules it
    breaks (space: the table, key: a bit per rule); every row names its keys (space:
    table.column) as their owner, and its parent's key as a child. Spaces are numbers:
    they are hashed and moved with every key."""
    ddl, at = DDL[table], {name: k for k, name in enumerate(_spaces())}
    broken = sum((F.when(cond, F.lit(1 << k)).otherwise(0) for k, cond in enumerate(column_rules(table).values())), F.lit(0))
    keys = [(f"{table}.{c}", c, OWNER) for c in ddl.get("unique", ())]
    if "parent" in ddl:
        _, c, parent = ddl["parent"]
        keys.append((f"{parent}.id", c, CHILD))
    say = lambda space, key, role: F.struct(F.lit(at[space]).alias("space"), key.cast("string").alias("key"), F.lit(role).alias("role"))
    rows = df.select(*[F.col(k).cast("string").alias(f"_key{n}") for n, (_, k, _) in enumerate(keys)], broken.alias("_broken"))
    rules, bad = say(table, F.col("_broken"), RULES), F.col("_broken") > 0
    named = [(F.col(f"_key{n}").isNotNull(), say(space, F.col(f"_key{n}"), role)) for n, (space, _, role) in enumerate(keys)]
    if len(named) == 1:
        # a row says one thing, few say two: cases, which are compiled, in place of a filter of an array
        (has, key), = named
        said = F.when(bad & has, F.array(rules, key)).when(bad, F.array(rules)).when(has, F.array(key))
    else:
        said = F.filter(F.array(F.when(bad, rules), *(F.when(has, key) for has, key in named)), lambda x: x.isNotNull())
    return rows.select(F.explode(said).alias("x")).select("x.*")


def audit_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations of every rule of ``DDL`` in the six tables, a row per rule.

    Every table is read once. What its rows say goes into one union that is grouped
    once by (space, key), with a partial aggregate before the shuffle, so an order
    that holds a third of all items is one row per task: keys with several owners
    break uniqueness (all their rows count), keys with children but no owner break
    the parent rule (their children count), and the sets of broken column rules come
    with their number of rows. A second exchange adds up a few hundred rows."""
    said = None
    for table in DDL:
        said = _tagged(table, tables[table]) if said is None else said.unionByName(_tagged(table, tables[table]))
    role = F.col("role")
    met = said.groupBy("space", "key").agg(*(F.count_if(role == r).alias(n) for r, n in ((RULES, "rows"), (OWNER, "owners"), (CHILD, "children"))))

    at = {name: k for k, name in enumerate(_spaces())}
    hit = lambda table, rule, n: F.struct(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), n.alias("n"))
    found, every = F.array().cast("array<struct<table_name:string,rule:string,n:bigint>>"), []
    for table, ddl in DDL.items():
        names = list(column_rules(table))
        bits = F.col("key").cast("long")
        found = F.when(F.col("space") == at[table], F.filter(F.array(*(
            F.when(bits.bitwiseAND(F.lit(1 << k)) != 0, hit(table, r, F.col("rows"))) for k, r in enumerate(names))), lambda x: x.isNotNull())).otherwise(found)
        every += [(table, r) for r in names]
    for table, ddl in DDL.items():
        children = [(t, d["parent"][0]) for t, d in DDL.items() if "parent" in d and d["parent"][2] == table]
        for c in ddl.get("unique", ()):
            own = [F.when(F.col("owners") > 1, hit(table, f"{c}_unique", F.col("owners")))]
            own += [F.when(F.col("owners") == 0, hit(t, r, F.col("children"))) for t, r in children if c == "id"]
            found = F.when(F.col("space") == at[f"{table}.{c}"], F.filter(F.array(*own), lambda x: x.isNotNull())).otherwise(found)
            every.append((table, f"{c}_unique"))
        every += children
    rows = met.select(F.explode(found).alias("x")).select("x.*")
    # every rule has a row, those that nothing breaks too
    none = rows.sparkSession.createDataFrame([(t, r, 0) for t, r in every], "table_name string, rule string, n long")
    return rows.unionByName(none).groupBy("table_name", "rule").agg(F.sum("n").alias("violations"))
