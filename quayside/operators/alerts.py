"""Alert rules (low stock, demand surge, low demand, failed forecast), their
union, the as-of stock lookup they need, and the notification renderings.

Every rule is a projection over a table of events, so all alerts of a batch
come out of one pass; ids are deterministic hashes so replays dedupe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import AlertThresholds, DEFAULT_THRESHOLDS
from ..functions.expr import half_up_int, instant_text, joined_key, stable_id

ALERT_COLUMNS = ("id", "type", "severity", "product_id", "sku", "title", "message", "occurred_at")


def _alert(df: DataFrame, type_: str, severity: Column, title: Column, message: Column,
           event_key: str, ts: str) -> DataFrame:
    return df.select(
        stable_id(F.lit(type_), F.col("product_id"), F.col(event_key)).alias("id"),
        F.lit(type_).alias("type"),
        severity.alias("severity"),
        F.col("product_id"),
        F.col("sku"),
        title.alias("title"),
        message.alias("message"),
        F.col(ts).alias("occurred_at"),
    )


# ------------------------------------------------------------------------- P12
def downward_adjustments(product_events: DataFrame) -> DataFrame:
    """STOCK_ADJUSTED events with a negative delta (a null delta never passes)."""
    return product_events.where((F.col("eventType") == "STOCK_ADJUSTED")
                                & (F.col("stockDelta") < 0))


def stock_event_key(ts: str = "occurredAt", stock: str = "stockQuantity", delta: str = "stockDelta",
                    seq: str = "eventSeq") -> Column:
    """What tells stock events of one product apart, from their own content: the
    instant, stock, change and sequence number (which a record may lack)."""
    return joined_key(F.unix_micros(F.col(ts).cast("timestamp")), stock, delta, seq)


# ------------------------------------------------------------------------- R1
def low_stock(stock_events: DataFrame, thresholds: AlertThresholds = DEFAULT_THRESHOLDS,
              event_key: str = "event_id", ts: str = "occurred_at",
              stock: str = "stock_quantity") -> DataFrame:
    """stock <= threshold -> LOW_STOCK, CRITICAL at 0, WARNING otherwise."""
    t = thresholds.low_stock
    hit = stock_events.where(F.col(stock) <= t)
    return _alert(
        hit, "LOW_STOCK",
        F.when(F.col(stock) == 0, "CRITICAL").otherwise("WARNING"),
        F.format_string(C.LOW_STOCK_TITLE, F.col("sku")),
        F.format_string(C.LOW_STOCK_MESSAGE, F.col("sku"), F.col(stock).cast("int"), F.lit(t)),
        event_key, ts)


def _surge_threshold(stock: Column, thresholds: AlertThresholds) -> Column:
    # BigDecimal.valueOf(stock * multiplier): the double product, made exact
    return (stock.cast("double") * F.lit(thresholds.surge_multiplier)).cast("decimal(20,2)")


# ------------------------------------------------------------------------- R2
def demand_surge(results: DataFrame, thresholds: AlertThresholds = DEFAULT_THRESHOLDS,
                 event_key: str = "job_id", ts: str = "occurred_at",
                 total: str = "total_predicted_demand", stock: str = "current_stock") -> DataFrame:
    """total > stock x multiplier -> DEMAND_SURGE, CRITICAL."""
    thr = _surge_threshold(F.col(stock), thresholds)
    hit = results.where(F.col(total).isNotNull() & (F.col(total) > thr))
    return _alert(
        hit, "DEMAND_SURGE", F.lit("CRITICAL"),
        F.format_string(C.SURGE_TITLE, F.col("sku")),
        # %.0f of the decimals, rounded half up, printed as whole numbers
        F.format_string(C.SURGE_MESSAGE, half_up_int(F.col(total)), F.col(stock).cast("int"),
                        half_up_int(thr)),
        event_key, ts)


# ------------------------------------------------------------------------- R3
def low_demand(results: DataFrame, thresholds: AlertThresholds = DEFAULT_THRESHOLDS,
               event_key: str = "job_id", ts: str = "occurred_at",
               total: str = "total_predicted_demand") -> DataFrame:
    """total < low-demand threshold -> LOW_DEMAND_FORECAST, INFO (independent of R2)."""
    hit = results.where(F.col(total) < F.lit(thresholds.low_demand))
    return _alert(
        hit, "LOW_DEMAND_FORECAST", F.lit("INFO"),
        F.format_string(C.LOW_DEMAND_TITLE, F.col("sku")),
        F.format_string(C.LOW_DEMAND_MESSAGE, half_up_int(F.col(total))),
        event_key, ts)


# ------------------------------------------------------------------------- R4
def forecast_failed(failures: DataFrame, event_key: str = "job_id", ts: str = "occurred_at",
                    message: str = "error_message") -> DataFrame:
    """Every failed forecast -> FORECAST_FAILED, WARNING, with the reason."""
    return _alert(
        failures, "FORECAST_FAILED", F.lit("WARNING"),
        F.format_string(C.FAILED_TITLE, F.col("sku")),
        F.format_string(C.FAILED_MESSAGE, F.col("sku"), F.col(message)),
        event_key, ts)


# ------------------------------------------------------------------------- U1
def forecast_alerts(results: DataFrame, thresholds: AlertThresholds = DEFAULT_THRESHOLDS,
                    event_key: str = "job_id", ts: str = "occurred_at") -> DataFrame:
    """Zero, one or two alerts per forecast result in one pass: the rule outcomes
    go into an array, nulls are filtered out and the rest exploded.

    Input: product_id, sku, status, total_predicted_demand, current_stock,
    error_message, the event key and time. COMPLETED with a null total is ignored.
    """
    total, stock = F.col("total_predicted_demand"), F.col("current_stock")
    thr = _surge_threshold(stock, thresholds)
    completed = (F.col("status") == "COMPLETED") & total.isNotNull()

    def rule(cond, type_, sev, title, msg):
        return F.when(cond, F.struct(F.lit(type_).alias("type"), F.lit(sev).alias("severity"),
                                     title.alias("title"), msg.alias("message")))

    rules = F.array(
        rule(completed & (total > thr), "DEMAND_SURGE", "CRITICAL",
             F.format_string(C.SURGE_TITLE, F.col("sku")),
             F.format_string(C.SURGE_MESSAGE, half_up_int(total), stock.cast("int"), half_up_int(thr))),
        rule(completed & (total < F.lit(thresholds.low_demand)), "LOW_DEMAND_FORECAST", "INFO",
             F.format_string(C.LOW_DEMAND_TITLE, F.col("sku")),
             F.format_string(C.LOW_DEMAND_MESSAGE, half_up_int(total))),
        rule(F.col("status") == "FAILED", "FORECAST_FAILED", "WARNING",
             F.format_string(C.FAILED_TITLE, F.col("sku")),
             F.format_string(C.FAILED_MESSAGE, F.col("sku"), F.col("error_message"))),
    )
    fired = results.select("product_id", "sku", event_key, ts,
                           F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("a"))
    return fired.select(
        stable_id(F.col("a.type"), F.col("product_id"), F.col(event_key)).alias("id"),
        F.col("a.type").alias("type"), F.col("a.severity").alias("severity"),
        "product_id", "sku", F.col("a.title").alias("title"), F.col("a.message").alias("message"),
        F.col(ts).alias("occurred_at"))


def all_alerts(*parts: DataFrame) -> DataFrame:
    """Union of rule outputs by column name."""
    out = parts[0].select(*ALERT_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*ALERT_COLUMNS))
    return out


# ------------------------------------------------------------------------- J7
def stock_as_of(events: DataFrame, stock: DataFrame, key: str = "product_id",
                t: str = "occurred_at", stock_ts: str = "ts", stock_seq: str = "event_id",
                stock_col: str = "balance", default: int | None = C.DEFAULT_CURRENT_STOCK,
                buckets: tuple[str, ...] = ("hour", "day")) -> DataFrame:
    """Each event gets the product's latest stock at or before its time (a
    stock row at the same instant counts; among equal instants the highest
    sequence wins).

    Time is cut into nested buckets (``date_trunc`` units, finest first). The
    answer is the last stock row of the event's finest bucket at or before the
    event (a running ``last(ignorenulls)`` over those stock rows and the events,
    ordered by time), else the last row of the latest earlier finest bucket in
    the same next-coarser bucket, and so on up to the coarsest level, which is
    carried across a product's whole history. Stock is pre-aggregated to one
    row per bucket before every carry, so no window partition holds more than
    one finest bucket's rows or one row per sub-bucket, and no stock row is
    paired with an event.
    """
    units = tuple(buckets)
    bcol = [f"_b{i}" for i in range(len(units))]
    cut = lambda c: [F.date_trunc(u, F.col(c)).alias(b) for u, b in zip(units, bcol)]
    st = stock.select(F.col(key), F.struct(F.col(stock_ts).alias("o"), F.col(stock_seq).alias("s"))
                      .alias("_pos"), F.col(stock_col).cast("bigint").alias("_stock"), *cut(stock_ts))
    # both levels below need the stock rows by (product, finest bucket): one
    # shuffle that both read, so an expensive stock input is computed once
    st = st.repartition(key, bcol[0])
    ev_keys = events.select(F.col(key), F.col(t), *cut(t)).distinct()
    pos_type = st.schema["_pos"].dataType

    # level 0: inside the event's finest bucket, at or before the event
    fine = ev_keys.select(key, bcol[0]).distinct()
    u = (st.join(fine, [key, bcol[0]], "left_semi")
         .select(key, bcol[0], F.col("_pos.o").alias("_o"), F.lit(0).alias("_side"),
                 F.col("_pos.s").alias("_seq"), "_stock", F.lit(None).cast(ev_keys.schema[t].dataType).alias(t))
         .unionByName(ev_keys.select(key, bcol[0], F.col(t).alias("_o"), F.lit(1).alias("_side"),
                                     F.lit(None).cast(pos_type["s"].dataType).alias("_seq"),
                                     F.lit(None).cast("bigint").alias("_stock"), F.col(t))))
    w0 = (Window.partitionBy(key, bcol[0]).orderBy("_o", "_side", "_seq")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = (u.select(key, t, "_side", F.last("_stock", ignorenulls=True).over(w0).alias("_v0"))
             .where(F.col("_side") == 1).drop("_side"))
    result = events.select("*", *cut(t)).join(found, [key, t], "left")
    values = ["_v0"]

    # levels 1..n: the last row of the latest earlier bucket of the finer unit
    lasts = st.groupBy(key, *bcol).agg(F.max_by(F.struct("_pos", "_stock"), "_pos").alias("_l"))
    for j in range(1, len(units) + 1):
        inner, outer = bcol[j - 1], bcol[j:j + 1]            # outer: [] at the top level
        marks = (ev_keys.select(key, *bcol[j - 1:]).distinct()
                 .select(key, inner, *outer, F.lit(None).cast("bigint").alias("_last"), F.lit(1).alias("_side"))
                 .unionByName(lasts.select(key, inner, *outer, F.col("_l._stock").alias("_last"),
                                           F.lit(0).alias("_side"))))
        w = (Window.partitionBy(key, *outer).orderBy(inner, F.col("_side").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
        carried = (marks.select(key, inner, *outer, "_side",
                                F.last("_last", ignorenulls=True).over(w).alias(f"_v{j}"))
                   .where(F.col("_side") == 1).drop("_side"))
        result = result.join(carried, [key, inner, *outer], "left")
        values.append(f"_v{j}")
        if j < len(units):
            lasts = (lasts.groupBy(key, *bcol[j:])
                     .agg(F.max_by(F.col("_l"), F.col("_l._pos")).alias("_l")))

    found_value = F.coalesce(*[F.col(v) for v in values])
    if default is not None:
        found_value = F.coalesce(found_value, F.lit(default))
    return (result.withColumn("current_stock", found_value.cast("int"))
            .drop(*values, *bcol))


# ------------------------------------------------------------------------- C10
def webhook_payload(alerts: DataFrame) -> DataFrame:
    """Chat-webhook JSON per alert: text ``*SEVERITY* — title\\nmessage`` and one
    attachment with the severity colour and four short fields."""
    colour = F.when(F.col("severity") == "CRITICAL", C.SEVERITY_COLOURS["CRITICAL"]) \
        .when(F.col("severity") == "WARNING", C.SEVERITY_COLOURS["WARNING"]) \
        .when(F.col("severity") == "INFO", C.SEVERITY_COLOURS["INFO"])

    def field(title, value):
        return F.struct(F.lit(title).alias("title"), value.cast("string").alias("value"),
                        F.lit(True).alias("short"))

    payload = F.struct(
        F.format_string("*%s* — %s\n%s", F.col("severity"), F.col("title"), F.col("message")).alias("text"),
        F.array(F.struct(colour.alias("color"), F.array(
            field("Type", F.col("type")), field("Severity", F.col("severity")),
            field("SKU", F.col("sku")),
            field("Time", instant_text("occurred_at")),
        ).alias("fields"))).alias("attachments"))
    return alerts.select("id", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


# ------------------------------------------------------------------------- C11
def log_lines(alerts: DataFrame) -> DataFrame:
    """Log level by severity and the log line of each alert."""
    level = F.when(F.col("severity") == "CRITICAL", C.SEVERITY_LOG_LEVELS["CRITICAL"]) \
        .when(F.col("severity") == "WARNING", C.SEVERITY_LOG_LEVELS["WARNING"]) \
        .otherwise(C.SEVERITY_LOG_LEVELS["INFO"])
    return alerts.select("id", level.alias("level"),
                         F.format_string(C.LOG_LINE, F.col("id"), F.col("type"), F.col("severity"),
                                         F.col("sku"), F.col("message")).alias("line"))
