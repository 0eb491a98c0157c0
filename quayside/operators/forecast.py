"""Demand history and the linear-trend x weekday forecaster, for all series at once.

Plan shape (checked with ``explain``): the history is shuffled once by the
series key; one sort feeds every window (positional index, series length,
training sums, weekday means); a group-by on the same key reuses that
partitioning, so fitting all series costs one exchange of the (series, day)
rows. A series holds at most one row per day, so no series can grow beyond the
number of days covered, however hot its product is in the raw item data; the
raw items are pre-aggregated map-side before that shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.expr import round_even, stable_id, weekday_mon0
from ..session import ensure_checkpoint_dir

Keys = Sequence[str]


# --------------------------------------------------------------------------- A7
def daily_demand(items: DataFrame, key: str = "product_id", ts: str = "occurred_at",
                 qty: str = "quantity", since_days: int | None = None,
                 as_of: Column | None = None) -> DataFrame:
    """Sum of quantities per (product, calendar day). Partial aggregation runs
    before the shuffle, so a hot product costs one row per day per task."""
    day = F.to_date(F.col(ts))
    df = items
    if since_days is not None and as_of is not None:
        df = df.where(day > F.date_sub(as_of, since_days))
    return (df.groupBy(F.col(key).alias(key), day.alias("ds"))
            .agg(F.sum(F.col(qty).cast("double")).alias("y")))


# --------------------------------------------------------------------------- F4
def keyed_items(items: DataFrame, order_key: str, content: Keys, carry: Keys = ()) -> DataFrame:
    """Order items have no identity, so each gets ``item_key`` = its content
    plus its index among identical items of the same order. Identical items
    are counted by a group-by (partially aggregated, no sort of an order's
    items) and expanded again with ``sequence``; equal items get equal
    forecasts, so their order does not matter."""
    return numbered_items(items, order_key, content, carry).select(order_key, item_key(content).alias("item_key"), *content, *carry)


def numbered_items(items: DataFrame, order_key: str, content: Keys, carry: Keys = ()) -> DataFrame:
    """The items with ``_dup``, their index among identical items of the same order."""
    g = items.groupBy(order_key, *content, *carry).agg(F.count(F.lit(1)).alias("_copies"))
    return g.select(order_key, *content, *carry, F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_dup"))


def item_key(content: Keys) -> Column:
    """The key of a numbered item."""
    return F.concat_ws(":", *[F.col(c).cast("string") for c in content], F.col("_dup").cast("string"))


# --------------------------------------------------------------------------- A8
def seed_history(items: DataFrame, keys: Keys, ts: str = "occurred_at",
                 qty: str = "quantity", days: int = C.SEED_HISTORY_DAYS) -> DataFrame:
    """For each item, ``days`` rows dated order day - days ... order day - 1,
    each with the item's quantity (the literal seed the order consumer builds).

    The items are hash-partitioned by the series key before the explode, so
    the shuffle moves one row per item instead of ``days`` rows, and the fit's
    windows on the same key need no exchange of their own. The partition
    count is explicit so AQE does not shrink it by the pre-explode size.
    """
    d = F.to_date(F.col(ts))
    # an explicit count: AQE would otherwise coalesce by the small pre-explode
    # size and leave the 30x larger exploded rows to a handful of tasks
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return items.repartition(n, *keys).select(*keys,
                        F.explode(F.sequence(F.date_sub(d, days), F.date_sub(d, 1))).alias("ds"),
                        F.col(qty).cast("double").alias("y"))


#: The pair of a seed history: what its rows are made of.
PAIR = ("_seed_day", "_seed_qty")
#: Pairs that may be sent to every executor (a model row takes some 200 bytes).
SENT_PAIRS = 250_000


def _paired(ts: str, qty: str) -> list[Column]:
    return [F.to_date(F.col(ts)).alias(PAIR[0]), F.col(qty).cast("double").alias(PAIR[1])]


def seed_pairs(seeds: DataFrame, ts: str = "occurred_at", qty: str = "quantity",
               horizon: int = C.DEFAULT_HORIZON) -> tuple[DataFrame, int, int]:
    """The checkpointed models of the distinct (day, quantity) pairs of ``seeds`` with
    their ``total_predicted_demand`` over ``horizon``, how many pairs there are and how
    many seeds."""
    keys = [*PAIR, "_items"]
    met = seeds.select(*_paired(ts, qty)).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_items"))
    model = fit(seed_history(met, keys, ts=PAIR[0], qty=PAIR[1]), keys).withColumn("total_predicted_demand", horizon_total(F.lit(horizon)))
    ensure_checkpoint_dir(seeds.sparkSession)
    model = model.checkpoint(eager=True)
    n = model.agg(F.count(F.lit(1)), F.sum("_items")).first()
    return model.drop("_items"), n[0], n[1] or 0


def with_pair(items: DataFrame, pairs: DataFrame, n_pairs: int, ts: str = "occurred_at", qty: str = "quantity") -> DataFrame:
    """Every item with its pair's row of ``pairs``. Few pairs are sent to the items,
    which are not moved for it. Of many, the join has a bare exchange on both sides, so
    adaptive execution may split a pair that very many items share."""
    of = pairs.withColumnsRenamed({c: f"{c}_of" for c in PAIR})
    of = F.broadcast(of) if n_pairs <= SENT_PAIRS else of
    same = (F.col(PAIR[0]) == F.col(f"{PAIR[0]}_of")) & F.col(PAIR[1]).eqNullSafe(F.col(f"{PAIR[1]}_of"))
    return items.select("*", *_paired(ts, qty)).join(of, same).drop(*PAIR, *(f"{c}_of" for c in PAIR))


def seed_models(items: DataFrame, keys: Keys, ts: str = "occurred_at", qty: str = "quantity",
                horizon: int = C.DEFAULT_HORIZON, carry: Keys = (), seeds: DataFrame | None = None) -> DataFrame:
    """The model row of every item's seed history (``keys``, ``carry``, the columns
    of ``fit`` and ``total_predicted_demand`` over ``horizon``).

    A seed history holds nothing but the item's quantity and order day, so items
    that agree in both have one model. The distinct pairs are fitted, whose number
    stops growing (quantities x days) while the items go on, and every item is
    joined with its pair's checkpointed row.

    ``seeds`` are rows with the same days and quantities as ``items`` that cost less
    to read (the items before they were keyed, say); the pairs are then taken from them.
    """
    pairs, n, _ = seed_pairs(items if seeds is None else seeds, ts, qty, horizon)
    own = [c for c in dict.fromkeys([*keys, *carry, ts, qty])]
    out = [*keys, *carry, *(c for c in pairs.columns if c not in PAIR)]
    return with_pair(items.select(*own), pairs, n, ts, qty).select(*out)


# ------------------------------------------------------------------- W1, W2, W3
def series_index(history: DataFrame, keys: Keys, ds: str = "ds") -> DataFrame:
    """0-based position by date (x), series length (n), training size (k), last date."""
    w_ord = Window.partitionBy(*keys).orderBy(ds)
    w_all = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w_all)
    return history.select(
        "*",
        (F.row_number().over(w_ord) - 1).cast("bigint").alias("x"),
        n.alias("n"),
        F.greatest(F.lit(1).cast("bigint"),
                   F.floor(n * F.lit(C.TRAIN_FRACTION)).cast("bigint")).alias("k"),
        F.max(ds).over(w_all).alias("last_ds"),
    )


def valid_series(history: DataFrame, keys: Keys, y: str = "y", ds: str = "ds",
                 min_points: int = C.MIN_HISTORY) -> DataFrame:
    """Rows of series the model accepts (>= 14 points, no negative quantity).

    Window aggregates on the series key: the check shares the exchange and
    sort of the fit that follows instead of a second pass plus a semi join.
    """
    # ordered by day with a full frame: the fit's windows reuse this sort
    w = (Window.partitionBy(*keys).orderBy(ds)
         .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (history.select("*", F.count(F.lit(1)).over(w).alias("_n"), F.min(y).over(w).alias("_min"))
            .where((F.col("_n") >= min_points) & (F.col("_min") >= 0)).drop("_n", "_min"))


def _train(c: Column) -> Column:
    return F.when(F.col("x") < F.col("k"), c)


# ------------------------------------------------------- A3, A4, A5, A6 (fit)
def fit(history: DataFrame, keys: Keys, ds: str = "ds", y: str = "y",
        min_points: int | None = None) -> DataFrame:
    """One model row per series: n, k, slope, intercept, seven weekday factors,
    validation MAE and last date.

    Least squares on x = 0..k-1 in closed form from exact integer-valued sums;
    weekday factor = weekday mean / training mean (mean <= 0 counts as 1.0);
    unseen weekdays get 1.0; MAE on the last 20 % with the clipped trend only.
    Every series gets a row with its length ``n`` and smallest quantity
    ``min_y`` (the request checks read them from this same pass); with
    ``min_points``, series the model refuses (too short, negative quantity)
    are left out.

    Two window passes over one sort (position/length, then the four training
    sums every row needs for its residual); the weekday sums and the MAE are
    conditional sums in the final hash aggregate, which is code-generated.
    """
    w_ord = Window.partitionBy(*keys).orderBy(ds)
    w_all = w_ord.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count(F.lit(1)).over(w_all)
    h = history.select(*keys, ds, F.col(y).cast("double").alias("y"))
    h = h.select("*", (F.row_number().over(w_ord) - 1).cast("bigint").alias("x"), n.alias("n"),
                 F.max(ds).over(w_all).alias("last_ds"))
    h = h.withColumn("k", F.greatest(F.lit(1).cast("bigint"),
                                     F.floor(F.col("n") * F.lit(C.TRAIN_FRACTION)).cast("bigint")))
    h = h.select("*",
                 F.sum(_train(F.col("x").cast("double"))).over(w_all).alias("sx"),
                 F.sum(_train(F.col("y"))).over(w_all).alias("sy"),
                 F.sum(_train(F.col("x") * F.col("y"))).over(w_all).alias("sxy"),
                 F.sum(_train((F.col("x") * F.col("x")).cast("double"))).over(w_all).alias("sxx"))
    kd = F.col("k").cast("double")
    den = kd * F.col("sxx") - F.col("sx") * F.col("sx")
    # a single training point has no slope (such series are refused upstream)
    slope = F.when(den != 0, (kd * F.col("sxy") - F.col("sx") * F.col("sy")) / den)
    h = h.withColumn("slope", slope)
    h = h.withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / kd)
    h = h.withColumn("dow", weekday_mon0(ds))
    val_err = F.when(F.col("x") >= F.col("k"),
                     F.abs(F.col("y") - F.greatest(F.lit(0.0),
                                                   F.col("slope") * F.col("x").cast("double")
                                                   + F.col("intercept"))))
    train_dow = [(F.col("x") < F.col("k")) & (F.col("dow") == i) for i in range(7)]
    agg = [F.max(c).alias(c) for c in ("n", "k", "slope", "intercept", "last_ds", "sy")]
    agg.append(F.min("y").alias("min_y"))
    agg += [F.sum(F.when(t, F.col("y"))).alias(f"dsum{i}") for i, t in enumerate(train_dow)]
    agg += [F.count(F.when(t, 1)).alias(f"dcnt{i}") for i, t in enumerate(train_dow)]
    agg.append(F.coalesce(F.avg(val_err), F.lit(0.0)).alias("mae_raw"))
    model = h.groupBy(*keys).agg(*agg)

    mean = F.col("sy") / F.col("k").cast("double")
    g = F.when(mean > 0, mean).otherwise(F.lit(1.0))
    factors = [F.coalesce(F.when(F.col(f"dcnt{i}") > 0, F.col(f"dsum{i}") / F.col(f"dcnt{i}")) / g,
                          F.lit(1.0)).alias(f"f{i}") for i in range(7)]
    model = model.select(*keys, "n", "k", "slope", "intercept", "last_ds", *factors,
                         round_even("mae_raw", 4).alias("mae"), "min_y")
    if min_points is not None:
        model = model.where((F.col("n") >= min_points) & (F.col("min_y") >= 0))
    return model


def _predicted(step: Column) -> Column:
    """The forecast of day ``step`` after the last one, from a model row."""
    date = F.date_add(F.col("last_ds"), step)
    x = (F.col("n") + step - 1).cast("double")
    trend = F.col("slope") * x + F.col("intercept")
    factor = F.element_at(F.array(*[F.col(f"f{i}") for i in range(7)]), weekday_mon0(date) + 1)
    # "+ 0.0" turns a -0.0 from rounding into 0.0
    return F.greatest(F.lit(0.0), round_even(trend * factor, 2)) + F.lit(0.0)


def horizon_total(horizon: Column) -> Column:
    """A2 on the model row itself: the exact sum of the predictions over the
    horizon, without a row per day."""
    days = F.transform(F.sequence(F.lit(1), horizon.cast("int")), lambda i: _predicted(i).cast("decimal(12,4)"))
    return F.aggregate(days, F.lit(0).cast("decimal(22,4)"), lambda acc, x: (acc + x).cast("decimal(22,4)")).cast("decimal(18,2)")


# ------------------------------------------------------------------------- F1
def points(model: DataFrame, keys: Keys, horizon: int | str | Column = C.DEFAULT_HORIZON,
           clamp_ingest: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Forecast rows for i = 1..horizon after the last observed day.

    predicted = max(0, round2(trend * factor[weekday])); std = max(0.5, 0.15 |pred|);
    lower = max(0, round2(pred - 1.96 std)); upper = round2(pred + 1.96 std).
    """
    h = F.lit(horizon) if isinstance(horizon, int) else (
        F.col(horizon) if isinstance(horizon, str) else horizon)
    m = model.select("*", F.explode(F.sequence(F.lit(1), h.cast("int"))).alias("step"))
    out = m.select(*keys, *carry, F.date_add(F.col("last_ds"), F.col("step")).alias("date"),
                   _predicted(F.col("step")).alias("predicted_quantity"))
    lower, upper = _bounds(F.col("predicted_quantity"))
    out = out.select("*", lower.alias("lower_bound"), upper.alias("upper_bound"))
    if clamp_ingest:
        out = clamp_negative(out)
    return out


def point_array(horizon: Column) -> Column:
    """The rows of ``points`` of a model row as one array, in date order. The bounds are
    taken from predictions that are there, not from the formula again."""
    days = F.transform(F.sequence(F.lit(1), horizon.cast("int")), lambda i: F.struct(
        F.date_add(F.col("last_ds"), i).alias("date"), _predicted(i).alias("predicted_quantity")))

    def bounded(day: Column) -> Column:
        lower, upper = _bounds(day["predicted_quantity"])
        return F.struct(day["date"].alias("date"), day["predicted_quantity"].alias("predicted_quantity"),
                        lower.alias("lower_bound"), upper.alias("upper_bound"))

    return F.transform(days, bounded)


def _bounds(predicted: Column) -> tuple[Column, Column]:
    std = F.greatest(F.lit(C.STD_FLOOR), F.abs(predicted) * F.lit(C.STD_FRACTION))
    return (F.greatest(F.lit(0.0), round_even(predicted - F.lit(C.Z_95) * std, 2)) + F.lit(0.0),
            round_even(predicted + F.lit(C.Z_95) * std, 2) + F.lit(0.0))


def responses(requests: DataFrame, history: DataFrame, keys: Keys, horizon: str = "horizon_days") -> DataFrame:
    """What a forecast request is answered with, for requests that the model takes:
    the request's columns, ``model_used``, ``forecast`` (an array of at most 365 days,
    made inside the row), ``mae`` and ``confidence_interval`` (the level of the bounds)."""
    r = requests.withColumn(horizon, F.coalesce(F.col(horizon), F.lit(C.DEFAULT_HORIZON))).join(
        fit(history, keys, min_points=C.MIN_HISTORY), list(keys))
    r = r.where(F.col(horizon).between(C.MIN_HORIZON, C.MAX_HORIZON))

    return r.select(*requests.columns, F.lit(C.MODEL_USED).alias("model_used"),
                    point_array(F.col(horizon)).alias("forecast"), "mae",
                    F.lit(C.CONFIDENCE).alias("confidence_interval"))


def clamp_negative(pts: DataFrame) -> DataFrame:
    """predicted, lower and upper each max(value, 0) when a result is taken in."""
    return pts.withColumns({c: F.greatest(F.col(c), F.lit(0.0))
                            for c in ("predicted_quantity", "lower_bound", "upper_bound")})


# ------------------------------------------------------------------------- A2
def total_demand(pts: DataFrame, keys: Keys) -> DataFrame:
    """Sum of predicted quantities over the horizon, exact in decimal(12,4) units."""
    return pts.groupBy(*keys).agg(
        F.sum(F.col("predicted_quantity").cast("decimal(12,4)")).cast("decimal(18,2)")
        .alias("total_predicted_demand"))


# ------------------------------------------------------------------------- V5
def history_checks(history: DataFrame, requests: DataFrame, keys: Keys,
                   horizon: str = "horizon_days", model: str = "model") -> DataFrame:
    """Per request: points, smallest quantity and the first failing rule (null = ok).

    Order of rules: model name, horizon range, history length, negative quantity.
    A request without any history row counts as zero points.
    """
    stats = history.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"),
                                       F.min("y").alias("min_y"))
    r = requests.join(stats, list(keys), "left").withColumn(
        "n_points", F.coalesce(F.col("n_points"), F.lit(0).cast("bigint")))
    return r.withColumn("failure_reason", _failure_reason(horizon, model))


def _failure_reason(horizon: str, model: str) -> Column:
    """First failing model rule, null when the request is accepted. Needs
    ``n_points`` and ``min_y`` next to the request columns."""
    return (F.when(F.coalesce(F.col(model), F.lit(C.MODEL_NAME)) != C.MODEL_NAME,
                   F.concat(F.lit("Unsupported model: "), F.col(model)))
            .when(~F.coalesce(F.col(horizon), F.lit(C.DEFAULT_HORIZON))
                  .between(C.MIN_HORIZON, C.MAX_HORIZON),
                  F.lit("horizonDays must be between 1 and 365"))
            .when(F.col("n_points") < C.MIN_HISTORY,
                  F.format_string("history needs at least 14 points, got %d", F.col("n_points")))
            .when(F.col("min_y") < 0, F.lit("quantity must be greater than or equal to 0")))


# ------------------------------------------------------------------------- F2
def run_jobs(requests: DataFrame, history: DataFrame, keys: Keys,
             horizon: str = "horizon_days", model: str = "model", request: Keys | None = None,
             registry: dict | None = None, pinned: bool = False, as_models: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every request becomes one job row, COMPLETED with model, MAE and total
    demand, or FAILED with the reason; plus the points of completed jobs.

    ``request`` names the columns that tell requests apart (default: the series
    keys, one request per series); job ids and points are keyed by them. A null
    horizon or model means the default. ``registry`` holds user models by name
    (``fn(series, horizon) -> points``, see ``custom_model``); their jobs have no
    MAE, and any other model name fails its job.

    The history is read once: one fit over all series yields both the request
    checks (length, smallest quantity) and the models. MAE and total come from
    the model's own row. Failing series are kept as FAILED rows, never dropped.
    ``pinned`` checkpoints the requests with their models, for plans that read jobs
    and points, or one of them in several branches. ``as_models`` (without a
    ``registry``) gives the model rows in place of the points, to move or join them
    before ``points`` makes 30 rows of each.
    """
    request, registry = list(request or keys), registry or {}
    requests = requests.withColumns({horizon: F.coalesce(F.col(horizon), F.lit(C.DEFAULT_HORIZON)),
                                     model: F.coalesce(F.col(model), F.lit(C.MODEL_NAME))})
    models = fit(history, keys)
    req = requests.join(models, list(keys), "left").withColumn(
        "n_points", F.coalesce(F.col("n"), F.lit(0).cast("bigint")))
    own = F.col(model).isin(*registry) if registry else F.lit(False)
    named = F.when(own, F.lit(C.MODEL_NAME)).otherwise(F.col(model))
    req = req.withColumn("_name", named).withColumn("failure_reason", _failure_reason(horizon, "_name")).withColumn("_own", own)
    if pinned:
        ensure_checkpoint_dir(req.sparkSession)
        req = req.checkpoint(eager=True)
    ok = F.col("failure_reason").isNull()
    native = ok & ~F.col("_own")
    out = req.where(native) if as_models else points(req.where(native), request, horizon, clamp_ingest=True)
    total = F.when(native, horizon_total(F.col(horizon)))
    kept = req.select(*requests.columns, "failure_reason", "_own", F.when(native, F.col("mae")).alias("mae"),
                      total.alias("_total"))
    for name, fn in registry.items():
        asked = req.where(ok & (F.col(model) == name)).select(
            *dict.fromkeys([*request, *keys]), F.col(horizon).cast("int").alias("_h"))
        made = _user_points(asked, history, keys, request, fn)
        out = out.unionByName(made)
        kept = (kept.join(total_demand(made, request), request, "left")
                .withColumn("_total", F.coalesce("_total", "total_predicted_demand")).drop("total_predicted_demand"))
    done = F.col("failure_reason").isNull()
    jobs = kept.select(
        stable_id(F.lit("job"), *request).alias("id"),
        *[F.col(c) for c in requests.columns],
        F.when(done, "COMPLETED").otherwise("FAILED").alias("status"),
        F.when(done, F.when(F.col("_own"), F.col(model)).otherwise(F.lit(C.MODEL_USED))).alias("model_used"),
        F.col("mae").cast("decimal(10,4)").alias("mae"),
        F.col("failure_reason").alias("error_message"),
        F.col("_total").alias("total_predicted_demand"))
    return jobs, out


def _user_points(asked: DataFrame, history: DataFrame, keys: Keys, request: Keys, fn) -> DataFrame:
    """A user model on the series of each request (a series has a row per day,
    so a group is bounded by the days covered)."""
    rows = asked.join(history, list(keys))
    schema = ", ".join([*(f"{k} {asked.schema[k].dataType.simpleString()}" for k in request),
                        "date date, predicted_quantity double, lower_bound double, upper_bound double"])
    return clamp_negative(_per_series(rows, request, fn, schema, "_h"))


# ------------------------------------------------------------------------- X1
def custom_model(history: DataFrame, keys: Keys, fn, horizon: int = C.DEFAULT_HORIZON,
                 schema: str | None = None) -> DataFrame:
    """Plug a user model in: ``fn(pandas history of one series, horizon) -> pandas
    points``. Runs per series with ``applyInPandas`` (a series is one row per day,
    so a group is bounded by the days covered)."""
    out_schema = schema or (", ".join(f"{k} {history.schema[k].dataType.simpleString()}" for k in keys)
                            + ", date date, predicted_quantity double, lower_bound double,"
                              " upper_bound double")

    return _per_series(history, keys, fn, out_schema, horizon)


def takes_many(fn):
    """Marks a user model ``fn(history, series, horizon) -> points`` that takes many
    series at once: ``history`` has their rows by series and day, ``series`` the first
    row of each (and one more at the end). It returns ``horizon`` points per series, in
    order, without key columns. A plain user model costs a call per series, this one a
    call per batch."""
    fn.takes_many = True
    return fn


# rows of a call; a series is never cut, so a longer one makes a longer call
SERIES_ROWS = 50_000


def _per_series(rows: DataFrame, keys: Keys, fn, schema: str, horizon: int | str, size: int = SERIES_ROWS) -> DataFrame:
    """A user model on every series of ``rows``. Marked models get whole series by the
    batch, out of partitions that are sorted by series and day; others get a series a
    call. ``horizon`` is a number or the column that holds each series' own."""
    keys, names = list(keys), [f.split()[0] for f in schema.split(", ")]
    if not getattr(fn, "takes_many", False):
        def run(pdf):
            got = fn(pdf.sort_values("ds").reset_index(drop=True), int(pdf[horizon].iloc[0]) if isinstance(horizon, str) else horizon)
            return got.assign(**{k: pdf[k].iloc[0] for k in keys})[names] if isinstance(horizon, str) else got

        return rows.groupBy(*keys).applyInPandas(run, schema)

    # the series as one column, which no earlier exchange is partitioned by
    rows = rows.withColumn("_series", F.struct(*keys)).withColumn("_part", F.xxhash64("_series"))
    ordered = rows.repartition("_part").sortWithinPartitions("_part", *keys, F.asc_nulls_last("ds")).drop("_series", "_part")

    def answer(pdf, first):
        own = pdf.iloc[first[:-1]].reset_index(drop=True)
        h = own[horizon].to_numpy(dtype=int) if isinstance(horizon, str) else np.full(len(own), horizon)
        for days in np.unique(h):                  # a call per horizon that is asked for
            at = np.flatnonzero(h == days)
            if len(at) < len(own):
                keep = np.repeat(h == days, np.diff(first))
                part, cut = pdf[keep].reset_index(drop=True), np.append(0, np.cumsum(np.diff(first)[at]))
            else:
                part, cut = pdf, first
            got = fn(part, cut, int(days))
            yield got.assign(**{k: own[k].to_numpy()[np.repeat(at, days)] for k in keys})[names]

    def run(it):
        held, n = [], 0
        for pdf in it:
            if pdf.empty:
                continue
            held, n = [*held, pdf], n + len(pdf)
            if n < size:
                continue
            pdf = pd.concat(held, ignore_index=True)
            first = _series_starts(pdf, keys)
            held, n = [pdf.iloc[first[-1]:]], len(pdf) - first[-1]  # the last series may go on
            if len(first) > 1:
                yield from answer(pdf.iloc[:first[-1]], first)
        if held:
            pdf = pd.concat(held, ignore_index=True)
            yield from answer(pdf, np.append(_series_starts(pdf, keys), len(pdf)))

    return ordered.mapInPandas(run, schema)


def _series_starts(pdf: pd.DataFrame, keys: Keys) -> np.ndarray:
    """Rows where a series begins; null keys are equal to each other."""
    new = np.zeros(len(pdf), dtype=bool)
    new[0] = True
    for k in keys:
        v, null = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
        new[1:] |= ~((v[1:] == v[:-1]) | (null[1:] & null[:-1])).astype(bool)
    return np.flatnonzero(new)


def forecast_with(model_name: str, history: DataFrame, keys: Keys,
                  horizon: int = C.DEFAULT_HORIZON, registry: dict | None = None) -> DataFrame:
    """Model registry: the built-in model runs natively; a registered callable
    runs through ``custom_model``; an unknown name raises like the model server."""
    if model_name == C.MODEL_NAME:
        return points(fit(history, keys), keys, horizon)
    if registry and model_name in registry:
        return custom_model(history, keys, registry[model_name], horizon)
    raise ValueError(f"Unsupported model: {model_name}")
