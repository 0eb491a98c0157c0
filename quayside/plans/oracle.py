"""DuckDB SQL twins of the registered queries (the correctness oracle).

Written independently of the Spark code: folds use ``list_reduce``, as-of
lookups use ``ASOF LEFT JOIN``. Constants are written as ``::DOUBLE`` so
DuckDB does not turn them into decimals.
"""

from __future__ import annotations

from ..sources.fixtures import FAULT_MODULUS, FAULTS

ORACLE: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLE[name] = text.strip()


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


# ------------------------------------------------------------ model tables
PRODUCTS = """
products AS (
  SELECT p_partkey AS product_id, p_name AS name, printf('SKU-%06d', p_partkey) AS sku,
         p_type AS category, CAST(p_retailprice AS DECIMAL(12,2)) AS price,
         CAST((p_partkey * 37) % 121 AS INTEGER) AS stock_quantity,
         CAST(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(p_partkey) AS TIMESTAMP) AS created_at,
         CAST(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(p_partkey) AS TIMESTAMP) AS updated_at,
         CAST(0 AS BIGINT) AS version
  FROM part)"""

ORDERS_M = """
orders_m AS (
  SELECT o_orderkey AS id, o_custkey AS customer_id,
         CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'O' THEN 'CONFIRMED' WHEN 'P' THEN 'PENDING' END AS status,
         o_orderdate AS created_at, o_orderdate AS updated_at, CAST(0 AS BIGINT) AS version
  FROM orders)"""

ITEMS = """
items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, printf('SKU-%06d', l_partkey) AS sku,
         CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price
  FROM lineitem)"""

HIST = """
hist AS (
  SELECT l.l_partkey AS product_id, CAST(o.o_orderdate AS DATE) AS ds, SUM(l.l_quantity) AS y
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE o.o_orderstatus <> 'P'
  GROUP BY 1, 2)"""

DELTAS = """
deltas AS (
  SELECT user_id AS product_id, ts, event_id,
         CAST(CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE -1 END * floor(value) AS BIGINT) AS delta
  FROM events WHERE event_type IN ('signup', 'view', 'purchase', 'click'))"""

ORDER_EVENTS = """
order_events AS (
  SELECT user_id * 100000 + (CAST(ts AS DATE) - DATE '1970-01-01') AS order_id, ts, event_id,
         CASE event_type WHEN 'view' THEN 'CONFIRM' WHEN 'click' THEN 'SHIP'
                         WHEN 'purchase' THEN 'DELIVER' WHEN 'error' THEN 'CANCEL' END AS action
  FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error'))"""

JOB_EVENTS = """
job_events AS (
  SELECT user_id * 100000 + (CAST(ts AS DATE) - DATE '1970-01-01') AS job_id, ts, event_id,
         CASE event_type WHEN 'signup' THEN 'START' WHEN 'click' THEN 'START'
                         WHEN 'view' THEN 'COMPLETE' WHEN 'error' THEN 'FAIL' END AS action
  FROM events WHERE event_type IN ('signup', 'click', 'view', 'error'))"""

# ------------------------------------------------------------ forecasting
IDX = """
idx AS (
  SELECT product_id, ds, y,
         CAST(row_number() OVER (PARTITION BY product_id ORDER BY ds) - 1 AS BIGINT) AS x,
         count(*) OVER (PARTITION BY product_id) AS n,
         greatest(CAST(1 AS BIGINT),
                  CAST(floor(count(*) OVER (PARTITION BY product_id) * 0.8::DOUBLE) AS BIGINT)) AS k,
         max(ds) OVER (PARTITION BY product_id) AS last_ds,
         isodow(ds) - 1 AS dow
  FROM {src})"""

VALID = """
valid AS (
  SELECT * FROM hist WHERE product_id IN (
    SELECT product_id FROM hist GROUP BY product_id HAVING count(*) >= 14 AND min(y) >= 0))"""


def _fit_ctes(src: str, keys: str, p: str = "") -> list[str]:
    dows = ",\n".join(
        f"sum(y) FILTER (WHERE x < k AND dow = {i}) AS dsum{i}, "
        f"count(*) FILTER (WHERE x < k AND dow = {i}) AS dcnt{i}" for i in range(7))
    idx = f"""
{p}idx AS (
  SELECT {keys}, ds, y,
         CAST(row_number() OVER (PARTITION BY {keys} ORDER BY ds) - 1 AS BIGINT) AS x,
         count(*) OVER (PARTITION BY {keys}) AS n,
         greatest(CAST(1 AS BIGINT),
                  CAST(floor(count(*) OVER (PARTITION BY {keys}) * 0.8::DOUBLE) AS BIGINT)) AS k,
         max(ds) OVER (PARTITION BY {keys}) AS last_ds,
         isodow(ds) - 1 AS dow
  FROM {src})"""
    sums = f"""
{p}sums AS (
  SELECT {keys}, max(n) AS n, max(k) AS k, max(last_ds) AS last_ds,
         sum(CAST(x AS DOUBLE)) FILTER (WHERE x < k) AS sx,
         sum(y) FILTER (WHERE x < k) AS sy,
         sum(x * y) FILTER (WHERE x < k) AS sxy,
         sum(CAST(x * x AS DOUBLE)) FILTER (WHERE x < k) AS sxx,
         {dows}
  FROM {p}idx GROUP BY {keys})"""
    coef = f"""
{p}coef AS (
  SELECT *, (CAST(k AS DOUBLE) * sxy - sx * sy) / (CAST(k AS DOUBLE) * sxx - sx * sx) AS slope FROM {p}sums)"""
    facs = ",\n".join(
        f"coalesce(CASE WHEN dcnt{i} > 0 THEN (dsum{i} / dcnt{i}) / g END, 1.0::DOUBLE) AS f{i}"
        for i in range(7))
    model0 = f"""
{p}model0 AS (
  SELECT *, (sy - slope * sx) / CAST(k AS DOUBLE) AS intercept,
         CASE WHEN sy / CAST(k AS DOUBLE) > 0 THEN sy / CAST(k AS DOUBLE) ELSE 1.0::DOUBLE END AS g
  FROM {p}coef)"""
    model1 = f"""
{p}model1 AS (SELECT *, {facs} FROM {p}model0)"""
    mae = f"""
{p}maes AS (
  SELECT i.{keys.replace(', ', ', i.')},
         avg(abs(i.y - greatest(0.0::DOUBLE, m.slope * CAST(i.x AS DOUBLE) + m.intercept)))
           FILTER (WHERE i.x >= i.k) AS mae_raw
  FROM {p}idx i JOIN {p}model1 m USING ({keys})
  GROUP BY {', '.join('i.' + k for k in keys.split(', '))})"""
    model = f"""
{p}model AS (
  SELECT m.*, round_even(coalesce(e.mae_raw, 0.0::DOUBLE) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE AS mae
  FROM {p}model1 m JOIN {p}maes e USING ({keys}))"""
    return [idx, sums, coef, model0, model1, mae, model]


def _points_ctes(keys: str, horizon: str = "30", p: str = "") -> list[str]:
    steps = f"""
{p}steps AS (
  SELECT {keys}, n, slope, intercept, last_ds, [f0, f1, f2, f3, f4, f5, f6] AS fs,
         unnest(range(1, {horizon} + 1)) AS step
  FROM {p}model)"""
    pred = f"""
{p}pred AS (
  SELECT {keys}, CAST(last_ds + CAST(step AS INTEGER) AS DATE) AS date,
         greatest(0.0::DOUBLE,
                  round_even((slope * CAST(n + step - 1 AS DOUBLE) + intercept)
                             * fs[isodow(last_ds + CAST(step AS INTEGER))] * 100.0::DOUBLE, 0) / 100.0::DOUBLE)
           + 0.0::DOUBLE AS predicted_quantity
  FROM {p}steps)"""
    pts = f"""
{p}pts AS (
  SELECT {keys}, date, predicted_quantity,
         greatest(0.0::DOUBLE, round_even((predicted_quantity - 1.96::DOUBLE
                  * greatest(0.5::DOUBLE, abs(predicted_quantity) * 0.15::DOUBLE)) * 100.0::DOUBLE, 0)
                  / 100.0::DOUBLE) + 0.0::DOUBLE AS lower_bound,
         round_even((predicted_quantity + 1.96::DOUBLE
                  * greatest(0.5::DOUBLE, abs(predicted_quantity) * 0.15::DOUBLE)) * 100.0::DOUBLE, 0)
                  / 100.0::DOUBLE + 0.0::DOUBLE AS upper_bound
  FROM {p}pred)"""
    return [steps, pred, pts]


FIT = _fit_ctes("valid", "product_id")
POINTS = _points_ctes("product_id")

sql("daily_demand", with_(HIST) + "SELECT product_id, ds, y FROM hist")

sql("series_index", with_(HIST, IDX.format(src="hist")) + "SELECT product_id, ds, y, x, n FROM idx")

sql("train_val_split", with_(HIST, IDX.format(src="hist"))
    + "SELECT product_id, ds, x, k, x < k AS is_train FROM idx")

sql("dow_means", with_(HIST, VALID, IDX.format(src="valid"))
    + "SELECT product_id, CAST(dow AS INTEGER) AS dow, avg(y) AS mean_y FROM idx WHERE x < k GROUP BY 1, 2")

sql("seasonal_factors", with_(HIST, VALID, *FIT) + """
SELECT product_id, CAST(d.dow AS INTEGER) AS dow,
       [f0, f1, f2, f3, f4, f5, f6][d.dow + 1] AS factor
FROM model CROSS JOIN (SELECT unnest(range(0, 7)) AS dow) d""")

sql("trend_fit", with_(HIST, VALID, *FIT) + "SELECT product_id, n, k, slope, intercept FROM model")

sql("forecast_mae", with_(HIST, VALID, *FIT) + "SELECT product_id, mae FROM model")

sql("forecast_points", with_(HIST, VALID, *FIT, *POINTS)
    + "SELECT product_id, date, predicted_quantity, lower_bound, upper_bound FROM pts")

sql("total_predicted_demand", with_(HIST, VALID, *FIT, *POINTS) + """
SELECT product_id,
       CAST(CAST(sum(CAST(predicted_quantity AS DECIMAL(12,4))) AS DECIMAL(18,2)) AS DOUBLE) AS total_predicted_demand
FROM pts GROUP BY product_id""")

CHECKS = """
checks AS (
  SELECT p.product_id, p.sku, coalesce(h.n_points, 0) AS n_points, h.min_y,
         CASE WHEN coalesce(h.n_points, 0) < 14
                THEN printf('history needs at least 14 points, got %d', coalesce(h.n_points, 0))
              WHEN h.min_y < 0 THEN 'quantity must be greater than or equal to 0' END AS failure_reason
  FROM products p
  LEFT JOIN (SELECT product_id, count(*) AS n_points, min(y) AS min_y FROM hist GROUP BY 1) h
    USING (product_id))"""

sql("validate_history", with_(PRODUCTS, HIST, CHECKS)
    + "SELECT product_id, n_points, failure_reason FROM checks")

TOTALS = """
totals AS (
  SELECT product_id,
         CAST(sum(CAST(greatest(predicted_quantity, 0.0::DOUBLE) AS DECIMAL(12,4))) AS DECIMAL(18,2)) AS total
  FROM pts GROUP BY product_id)"""

JOBS = """
jobs AS (
  SELECT sha256('job:' || CAST(c.product_id AS VARCHAR)) AS id, c.product_id, c.sku,
         30 AS horizon_days,
         CASE WHEN c.failure_reason IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status,
         CASE WHEN c.failure_reason IS NULL THEN 'linear-trend' END AS model_used,
         CAST(m.mae AS DECIMAL(10,4)) AS mae,
         c.failure_reason AS error_message,
         t.total AS total_predicted_demand
  FROM checks c LEFT JOIN model m USING (product_id) LEFT JOIN totals t USING (product_id))"""

sql("forecast_jobs", with_(PRODUCTS, HIST, CHECKS, VALID, *FIT, *POINTS, TOTALS, JOBS)
    + "SELECT id, product_id, sku, horizon_days, status, model_used, CAST(mae AS DOUBLE) AS mae, "
      "error_message, CAST(total_predicted_demand AS DOUBLE) AS total_predicted_demand FROM jobs")

sql("forecast_jobs_by_request", with_(PRODUCTS, HIST, CHECKS, VALID, *FIT, *_points_ctes("product_id", "30")) + """
, asked AS (SELECT c.*, r.request_no, r.h AS horizon_days,
                   CASE WHEN r.request_no < 4 THEN 'prophet' WHEN c.product_id % 3 = 0 THEN 'arima' ELSE 'mean' END AS model
            FROM checks c CROSS JOIN (VALUES (1, 7), (2, 30), (3, 30), (4, 5)) r(request_no, h)),
verdict AS (SELECT a.* EXCLUDE (failure_reason),
                   CASE WHEN model = 'arima' THEN 'Unsupported model: arima' ELSE failure_reason END AS reason FROM asked a),
own AS (SELECT product_id, round_even(avg(y) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE AS m FROM hist GROUP BY 1)
SELECT sha256('job:' || CAST(v.product_id AS VARCHAR) || ':' || CAST(v.request_no AS VARCHAR)) AS id, v.product_id, v.sku,
       v.request_no, v.horizon_days, v.model, CASE WHEN reason IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status,
       CASE WHEN reason IS NULL THEN CASE WHEN v.model = 'mean' THEN 'mean' ELSE 'linear-trend' END END AS model_used,
       CASE WHEN reason IS NULL AND v.model = 'prophet' THEN CAST(CAST(m.mae AS DECIMAL(10,4)) AS DOUBLE) END AS mae,
       reason AS error_message,
       CASE WHEN reason IS NULL THEN CASE WHEN v.model = 'mean'
            THEN CAST(CAST(5 * CAST(o.m AS DECIMAL(12,4)) AS DECIMAL(18,2)) AS DOUBLE)
            ELSE (SELECT CAST(CAST(sum(CAST(greatest(p.predicted_quantity, 0.0::DOUBLE) AS DECIMAL(12,4))) AS DECIMAL(18,2)) AS DOUBLE)
                  FROM pts p WHERE p.product_id = v.product_id AND p.date <= m.last_ds + CAST(v.horizon_days AS INTEGER)) END END
       AS total_predicted_demand
FROM verdict v LEFT JOIN model m USING (product_id) LEFT JOIN own o USING (product_id)""".replace("\n\n, asked", ",\nasked"))

CONF_ITEMS = """
conf_items AS (
  SELECT order_id,
         concat_ws(':', CAST(product_id AS VARCHAR), sku, CAST(quantity AS VARCHAR), CAST(unit_price AS VARCHAR),
                   CAST(row_number() OVER (PARTITION BY order_id, product_id, sku, quantity, unit_price) - 1
                        AS VARCHAR)) AS item_key,
         occurred_at, product_id, sku, quantity
  FROM (SELECT i.*, o.created_at AS occurred_at FROM items i
        JOIN orders_m o ON i.order_id = o.id WHERE o.status IN ('CONFIRMED', 'SHIPPED', 'DELIVERED')))"""

SEEDS = """
seeds AS (
  SELECT order_id, item_key,
         CAST(CAST(occurred_at AS DATE) - 30 + CAST(unnest(range(0, 30)) AS INTEGER) AS DATE) AS ds,
         CAST(quantity AS DOUBLE) AS y
  FROM conf_items)"""

sql("seed_history", with_(ORDERS_M, ITEMS, CONF_ITEMS, SEEDS) + "SELECT order_id, item_key, ds, y FROM seeds")

_ITEM_KEYS = "order_id, item_key"
sql("forecast_per_confirmed_item",
    with_(ORDERS_M, ITEMS, CONF_ITEMS, SEEDS, *_fit_ctes("seeds", _ITEM_KEYS), *_points_ctes(_ITEM_KEYS))
    + "SELECT order_id, item_key, date, greatest(predicted_quantity, 0.0::DOUBLE) AS predicted_quantity, "
      "greatest(lower_bound, 0.0::DOUBLE) AS lower_bound, greatest(upper_bound, 0.0::DOUBLE) AS upper_bound FROM pts")

# ------------------------------------------------------------ ledger (fold)
LEDGER = """
seqs AS (
  SELECT product_id, list(delta ORDER BY ts, event_id) AS ds, list(event_id ORDER BY ts, event_id) AS ids
  FROM deltas GROUP BY product_id),
folded AS (
  SELECT product_id, ids, ds,
         list_reduce(ds, lambda acc, d: list_append(acc,
             CASE WHEN acc[-1] + d >= 0 THEN acc[-1] + d ELSE acc[-1] END), [CAST(300 AS BIGINT)]) AS bal
  FROM seqs),
ledger AS (
  SELECT f.product_id, f.ids[i] AS event_id, f.ds[i] AS delta, f.bal[i] AS balance_before,
         f.bal[i + 1] AS balance, f.bal[i] + f.ds[i] >= 0 AS accepted
  FROM folded f, LATERAL (SELECT unnest(range(1, len(f.ds) + 1)) AS i))"""

sql("stock_ledger", with_(DELTAS, LEDGER) + """
SELECT l.product_id, d.ts, l.event_id, l.delta, l.balance_before, l.balance, l.accepted,
       CASE WHEN NOT l.accepted THEN printf('Cannot reduce stock below zero. Current: %d, Delta: %d',
                                            l.balance_before, l.delta) END AS message
FROM ledger l JOIN deltas d ON d.product_id = l.product_id AND d.event_id = l.event_id""")

# ------------------------------------------------------------ lifecycles (fold)
ORDER_STEP = """CASE
  WHEN s = 'PENDING' AND a = 'CONFIRM' THEN 'CONFIRMED'
  WHEN s = 'PENDING' AND a = 'CANCEL' THEN 'CANCELLED'
  WHEN s = 'CONFIRMED' AND a = 'SHIP' THEN 'SHIPPED'
  WHEN s = 'CONFIRMED' AND a = 'CANCEL' THEN 'CANCELLED'
  WHEN s = 'SHIPPED' AND a = 'DELIVER' THEN 'DELIVERED'
  ELSE s END"""

JOB_STEP = """CASE
  WHEN s = 'PENDING' AND a = 'START' THEN 'RUNNING'
  WHEN s = 'RUNNING' AND a = 'COMPLETE' THEN 'COMPLETED'
  WHEN s = 'RUNNING' AND a = 'FAIL' THEN 'FAILED'
  ELSE s END"""


def _lifecycle(src: str, key: str, step: str) -> str:
    step_acc = step.replace("s =", "acc[-1] =").replace("ELSE s", "ELSE acc[-1]")
    return f"""
lseq AS (
  SELECT {key}, list(action ORDER BY ts, event_id) AS acts, list(ts ORDER BY ts, event_id) AS tss,
         count(*) AS n_events
  FROM {src} GROUP BY {key}),
lfold AS (
  SELECT *, list_reduce(acts, lambda acc, a: list_append(acc, {step_acc}), ['PENDING']) AS states
  FROM lseq),
lsteps AS (
  SELECT l.{key}, l.n_events, i, l.acts[i] AS action, l.tss[i] AS ts,
         l.states[i] AS status_before, l.states[i + 1] AS status_after
  FROM lfold l, LATERAL (SELECT unnest(range(1, len(l.acts) + 1)) AS i))"""


sql("order_lifecycle", with_(ORDER_EVENTS, _lifecycle("order_events", "order_id", ORDER_STEP)) + """
SELECT order_id, arg_max(status_after, i) AS status, max(n_events) AS n_events,
       count(*) FILTER (WHERE status_before <> status_after) AS n_accepted,
       count(*) FILTER (WHERE status_before = status_after) AS n_refused,
       max(ts) FILTER (WHERE status_before <> status_after) AS last_change
FROM lsteps GROUP BY order_id""")

sql("order_rejections", with_(ORDER_EVENTS, _lifecycle("order_events", "order_id", ORDER_STEP)) + """
SELECT s.order_id, s.ts, e.event_id, s.action, s.status_before,
       CASE WHEN s.action = 'CONFIRM' THEN 'Only PENDING orders can be confirmed. Current: ' || s.status_before
            WHEN s.action = 'SHIP' THEN 'Only CONFIRMED orders can be shipped. Current: ' || s.status_before
            WHEN s.action = 'DELIVER' THEN 'Only SHIPPED orders can be delivered. Current: ' || s.status_before
            WHEN s.status_before = 'CANCELLED' THEN 'Order is already cancelled'
            ELSE 'Cannot cancel an order that is already ' || s.status_before END AS message
FROM lsteps s
JOIN (SELECT order_id, event_id, row_number() OVER (PARTITION BY order_id ORDER BY ts, event_id) AS i
      FROM order_events) e ON e.order_id = s.order_id AND e.i = s.i
WHERE s.status_before = s.status_after""")

sql("job_lifecycle", with_(JOB_EVENTS, _lifecycle("job_events", "job_id", JOB_STEP)) + """
SELECT job_id, arg_max(status_after, i) AS status, max(n_events) AS n_events,
       count(*) FILTER (WHERE status_before <> status_after) AS n_accepted,
       count(*) FILTER (WHERE status_before = status_after) AS n_refused,
       max(ts) FILTER (WHERE status_before <> status_after) AS last_change
FROM lsteps GROUP BY job_id""")

# ------------------------------------------------------------ alerts
RESULTS = """
ledger_ok AS (
  SELECT l.product_id, d.ts, l.event_id, l.balance, l.delta
  FROM ledger l JOIN deltas d ON d.product_id = l.product_id AND d.event_id = l.event_id
  WHERE l.accepted),
fevents AS (
  SELECT id AS job_id, product_id, sku, status, total_predicted_demand, error_message,
         CAST(TIMESTAMP '2024-01-10 12:00:00' + to_days(CAST(product_id % 15 AS INTEGER)) AS TIMESTAMP) AS occurred_at
  FROM jobs),
results AS (
  SELECT f.*, CAST(coalesce(s.balance, 100) AS INTEGER) AS current_stock
  FROM fevents f ASOF LEFT JOIN ledger_ok s
    ON f.product_id = s.product_id AND f.occurred_at >= s.ts)"""

sql("forecast_with_stock_asof",
    with_(PRODUCTS, HIST, CHECKS, VALID, *FIT, *POINTS, TOTALS, JOBS, DELTAS, LEDGER, RESULTS)
    + "SELECT job_id, product_id, occurred_at, CAST(total_predicted_demand AS DOUBLE) AS total_predicted_demand, "
      "current_stock FROM results")

ALERTS_SQL = """
fired AS (
  SELECT r.*, CAST(CAST(total_predicted_demand AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS tot,
         CAST(CAST(current_stock AS DOUBLE) * 2.0::DOUBLE AS DECIMAL(20,2)) AS thr
  FROM results r),
alerts AS (
  SELECT sha256('DEMAND_SURGE:' || CAST(product_id AS VARCHAR) || ':' || job_id) AS id,
         'DEMAND_SURGE' AS type, 'CRITICAL' AS severity, product_id, sku,
         'Demand Surge Alert: ' || sku AS title,
         printf('Forecast predicts %d units demand over next 30 days, but current stock is only %d units (surge threshold: %d). Restock urgently.',
                CAST(round(tot, 0) AS BIGINT), current_stock, CAST(round(thr, 0) AS BIGINT)) AS message,
         occurred_at
  FROM fired WHERE status = 'COMPLETED' AND tot IS NOT NULL AND tot > thr
  UNION ALL
  SELECT sha256('LOW_DEMAND_FORECAST:' || CAST(product_id AS VARCHAR) || ':' || job_id),
         'LOW_DEMAND_FORECAST', 'INFO', product_id, sku, 'Low Demand Forecast: ' || sku,
         printf('Forecast predicts only %d units demand over next 30 days. Consider promotions or stock reduction.',
                CAST(round(tot, 0) AS BIGINT)),
         occurred_at
  FROM fired WHERE status = 'COMPLETED' AND tot IS NOT NULL AND tot < 5
  UNION ALL
  SELECT sha256('FORECAST_FAILED:' || CAST(product_id AS VARCHAR) || ':' || job_id),
         'FORECAST_FAILED', 'WARNING', product_id, sku, 'Forecast Failed: ' || sku,
         printf('Demand forecast for %s failed: %s', sku, error_message), occurred_at
  FROM fired WHERE status = 'FAILED')"""

sql("all_alerts",
    with_(PRODUCTS, HIST, CHECKS, VALID, *FIT, *POINTS, TOTALS, JOBS, DELTAS, LEDGER, RESULTS, ALERTS_SQL)
    + "SELECT id, type, severity, product_id, sku, title, message, occurred_at FROM alerts")

# ------------------------------------------------------------ stored tables
_IK = "order_id, item_key"
ITEM_JOBS = [*_fit_ctes("seeds", _IK, "it_"), *_points_ctes(_IK, p="it_"), """
it_totals AS (
  SELECT order_id, item_key,
         CAST(sum(CAST(greatest(predicted_quantity, 0.0::DOUBLE) AS DECIMAL(12,4))) AS DECIMAL(18,2)) AS total
  FROM it_pts GROUP BY order_id, item_key)""", """
item_jobs AS (
  SELECT sha256('item:' || CAST(c.order_id AS VARCHAR) || ':' || c.item_key) AS id,
         c.product_id, c.sku, 30 AS horizon_days, 'COMPLETED' AS status, 'linear-trend' AS model_used,
         CAST(m.mae AS DECIMAL(10,4)) AS mae, CAST(NULL AS VARCHAR) AS error_message,
         t.total AS total_predicted_demand, c.occurred_at AS created_at, c.occurred_at AS updated_at,
         CAST(0 AS BIGINT) AS version
  FROM conf_items c JOIN it_model m USING (order_id, item_key) JOIN it_totals t USING (order_id, item_key))"""]

JOBS_ALL = """
jobs_all AS (
  SELECT id, product_id, sku, horizon_days, status, model_used, mae, error_message, total_predicted_demand,
         CAST(TIMESTAMP '2024-01-10 12:00:00' + to_days(CAST(product_id % 15 AS INTEGER)) AS TIMESTAMP) AS created_at,
         CAST(TIMESTAMP '2024-01-10 12:00:00' + to_days(CAST(product_id % 15 AS INTEGER)) AS TIMESTAMP) AS updated_at,
         CAST(0 AS BIGINT) AS version
  FROM jobs
  UNION ALL SELECT * FROM item_jobs)"""

POINTS_ALL = """
points_all AS (
  SELECT j.id AS job_id, p.date AS forecast_date,
         CAST(greatest(p.predicted_quantity, 0.0::DOUBLE) AS DECIMAL(12,4)) AS predicted_quantity,
         CAST(greatest(p.lower_bound, 0.0::DOUBLE) AS DECIMAL(12,4)) AS lower_bound,
         CAST(greatest(p.upper_bound, 0.0::DOUBLE) AS DECIMAL(12,4)) AS upper_bound
  FROM pts p JOIN jobs j USING (product_id)
  UNION ALL
  SELECT sha256('item:' || CAST(order_id AS VARCHAR) || ':' || item_key), date,
         CAST(greatest(predicted_quantity, 0.0::DOUBLE) AS DECIMAL(12,4)),
         CAST(greatest(lower_bound, 0.0::DOUBLE) AS DECIMAL(12,4)),
         CAST(greatest(upper_bound, 0.0::DOUBLE) AS DECIMAL(12,4))
  FROM it_pts)"""

def _faulty(table: str, source: str, columns: str) -> str:
    """Rows of a model table, broken in place where the faults say so."""
    _, number, faults = FAULTS[table]
    repl = []
    for c in dict.fromkeys(c for c, _ in faults):
        own = "CAST(product_id AS VARCHAR)" if (table, c) == ("alerts", "product_id") else c
        cases = " ".join(f"WHEN {number} % {FAULT_MODULUS} = {k} THEN {v}" for k, (x, v) in enumerate(faults) if x == c)
        repl.append(f"CASE {cases} ELSE {own} END AS {c}")
    return f"bad_{table} AS (SELECT * REPLACE ({', '.join(repl)}) FROM (SELECT {columns} FROM {source}))"


STORE = [PRODUCTS, ORDERS_M, ITEMS, HIST, CHECKS, VALID, *FIT, *POINTS, TOTALS, JOBS, CONF_ITEMS, SEEDS,
         *ITEM_JOBS, JOBS_ALL, POINTS_ALL]
JOB_COLS = ("id, product_id, sku, horizon_days, status, model_used, CAST(mae AS DOUBLE) AS mae, "
            "error_message, created_at, updated_at, version")
PRODUCT_COLS = ("product_id, name, sku, category, CAST(price AS DOUBLE) AS price, stock_quantity, "
                "created_at, updated_at, version")

sql("scan_products", with_(PRODUCTS) + f"SELECT {PRODUCT_COLS} FROM products")
sql("product_view", with_(PRODUCTS) + "SELECT product_id, name, sku, category, CAST(price AS DOUBLE) AS price, "
    "stock_quantity, created_at, updated_at FROM products")
sql("products_by_category", with_(PRODUCTS) + f"SELECT {PRODUCT_COLS} FROM products WHERE category = 'PROMO'")
sql("product_by_sku", with_(PRODUCTS) + f"SELECT {PRODUCT_COLS} FROM products WHERE sku = 'SKU-000042'")
sql("low_stock_products", with_(PRODUCTS) + f"SELECT {PRODUCT_COLS} FROM products WHERE stock_quantity <= 10")
sql("orders_by_customer", with_(ORDERS_M) + """
SELECT customer_id, id, status, created_at, updated_at, version FROM orders_m
WHERE customer_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
sql("orders_by_status", with_(ORDERS_M) + "SELECT * FROM orders_m WHERE status = 'PENDING'")
sql("jobs_by_product", with_(*STORE) + f"""
SELECT {JOB_COLS} FROM jobs_all WHERE product_id IN (SELECT product_id FROM products WHERE category = 'PROMO')""")
sql("jobs_by_status", with_(*STORE) + f"SELECT {JOB_COLS} FROM jobs_all WHERE status = 'FAILED'")
BAD_JOBS = _faulty("forecast_jobs", "jobs_all", "id, product_id, sku, horizon_days, status, model_used, mae, error_message, created_at, updated_at, version")
sql("terminal_jobs", with_(*STORE, BAD_JOBS) + f"""
SELECT * REPLACE (CAST(product_id AS DOUBLE) AS product_id, CAST(horizon_days AS DOUBLE) AS horizon_days, CAST(version AS DOUBLE) AS version)
FROM (SELECT {JOB_COLS} FROM bad_forecast_jobs WHERE status IN ('COMPLETED', 'FAILED'))""")
sql("latest_forecast", with_(*STORE) + f"""
SELECT {JOB_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY updated_at DESC, id) AS rn
  FROM jobs_all WHERE status = 'COMPLETED') WHERE rn = 1""")
sql("lookup_by_id", with_(PRODUCTS) + """
SELECT r.requested_id, p.product_id IS NOT NULL AS found, p.name, p.sku, p.category,
       CAST(p.price AS DOUBLE) AS price, CAST(p.stock_quantity AS DOUBLE) AS stock_quantity, p.created_at,
       p.updated_at, CAST(p.version AS DOUBLE) AS version
FROM (SELECT DISTINCT user_id * 20 AS requested_id FROM events) r
LEFT JOIN products p ON p.product_id = r.requested_id""")
sql("orders_with_items", with_(ORDERS_M, ITEMS) + """
SELECT o.id, o.customer_id, o.status, o.created_at, o.updated_at, o.version,
       CAST(i.product_id AS DOUBLE) AS product_id, i.sku, CAST(i.quantity AS DOUBLE) AS quantity,
       CAST(i.unit_price AS DOUBLE) AS unit_price
FROM orders_m o LEFT JOIN items i ON i.order_id = o.id""")
sql("order_totals", with_(ITEMS) + """
SELECT order_id, CAST(CAST(sum(unit_price * quantity) AS DECIMAL(18,2)) AS DOUBLE) AS total
FROM items GROUP BY order_id""")
sql("order_view", with_(ORDERS_M, ITEMS) + """
SELECT o.id, o.customer_id, o.status, o.created_at, o.updated_at, o.version,
       CAST(i.product_id AS DOUBLE) AS product_id, i.sku, CAST(i.quantity AS DOUBLE) AS quantity,
       CAST(i.unit_price AS DOUBLE) AS unit_price,
       CAST(CAST(i.unit_price * i.quantity AS DECIMAL(18,2)) AS DOUBLE) AS subtotal,
       CAST(coalesce(t.total, 0) AS DOUBLE) AS total
FROM orders_m o LEFT JOIN items i ON i.order_id = o.id
LEFT JOIN (SELECT order_id, CAST(sum(unit_price * quantity) AS DECIMAL(18,2)) AS total
           FROM items GROUP BY order_id) t ON t.order_id = o.id""")
sql("jobs_with_points", with_(*STORE) + """
SELECT j.id, j.product_id, j.status,
       CAST(row_number() OVER (PARTITION BY j.id ORDER BY p.forecast_date, p.predicted_quantity,
            p.lower_bound, p.upper_bound) - 1 AS DOUBLE) AS point_pos,
       p.forecast_date, CAST(p.predicted_quantity AS DOUBLE) AS predicted_quantity
FROM jobs_all j JOIN points_all p ON p.job_id = j.id
UNION ALL
SELECT j.id, j.product_id, j.status, CAST(NULL AS DOUBLE), CAST(NULL AS DATE), CAST(NULL AS DOUBLE)
FROM jobs_all j WHERE j.id NOT IN (SELECT job_id FROM points_all)""")
sql("forecast_job_view", with_(*STORE) + """
SELECT j.id, j.product_id, j.status, j.model_used,
       CASE WHEN j.model_used IS NOT NULL THEN CAST(j.mae AS DOUBLE) END AS mae,
       CASE WHEN j.model_used IS NOT NULL THEN CAST(coalesce(p.total, 0) AS DOUBLE) END AS total_predicted_demand,
       CASE WHEN j.model_used IS NOT NULL THEN CAST(coalesce(p.n, 0) AS DOUBLE) END AS n_points
FROM jobs_all j LEFT JOIN (
  SELECT job_id, CAST(sum(predicted_quantity) AS DECIMAL(18,2)) AS total, count(*) AS n
  FROM points_all GROUP BY job_id) p ON p.job_id = j.id""")

INCOMING = """
incoming AS (
  SELECT 1000000 + s_suppkey AS product_id, s_name AS name, printf('SKU-%06d', 1990 + s_nationkey) AS sku,
         'SUPPLIES' AS category, CAST(s_acctbal AS DECIMAL(12,2)) AS price,
         CAST(s_nationkey AS INTEGER) AS stock_quantity,
         CAST(TIMESTAMP '2024-01-01 00:00:00' + to_days(31) + to_seconds(s_suppkey) AS TIMESTAMP) AS created_at,
         CAST(TIMESTAMP '2024-01-01 00:00:00' + to_days(31) + to_seconds(s_suppkey) AS TIMESTAMP) AS updated_at
  FROM supplier)"""

sql("existing_skus", with_(PRODUCTS, INCOMING) + """
SELECT sku, product_id, name, category, CAST(price AS DOUBLE) AS price, stock_quantity, created_at, updated_at
FROM incoming WHERE sku IN (SELECT sku FROM products)""")
sql("admit_new_products", with_(PRODUCTS, INCOMING) + """
SELECT product_id, sku, CAST(price AS DOUBLE) AS price,
       NOT stored AND rn = 1 AS admitted,
       CASE WHEN stored OR rn > 1 THEN 'SKU already exists: ' || sku END AS reason
FROM (SELECT i.*, i.sku IN (SELECT sku FROM products) AS stored,
             row_number() OVER (PARTITION BY i.sku ORDER BY i.created_at, i.product_id) AS rn
      FROM incoming i)
WHERE stored OR rn >= 1""")
BAD_ITEMS = _faulty("order_items", "items", "*")
sql("orphan_children", with_(ORDERS_M, ITEMS, BAD_ITEMS) + """
SELECT CAST(order_id AS DOUBLE) AS order_id, CAST(product_id AS DOUBLE) AS product_id, sku, CAST(quantity AS DOUBLE) AS quantity,
       CAST(unit_price AS DOUBLE) AS unit_price
FROM bad_order_items i WHERE NOT EXISTS (SELECT 1 FROM orders_m o WHERE o.id = i.order_id)""")
sql("delete_cascade", with_(ORDERS_M, ITEMS) + """,
req AS (
  SELECT o_orderkey AS id FROM orders
  WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
  UNION SELECT 1000000000 + c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT o.id, 'kept' AS outcome, coalesce(n, 0) AS items_kept
FROM orders_m o LEFT JOIN (SELECT order_id, count(*) AS n FROM items
                           WHERE order_id NOT IN (SELECT id FROM req) GROUP BY 1) c ON c.order_id = o.id
WHERE o.id NOT IN (SELECT id FROM req)
UNION ALL
SELECT id, 'unknown', CAST(0 AS BIGINT) FROM req WHERE id NOT IN (SELECT id FROM orders_m)""".replace(
    "\n,\nreq", ",\nreq"))

# ------------------------------------------------------------ product events
LEDGER_TS = """
ledger_ts AS (
  SELECT l.*, d.ts FROM ledger l JOIN deltas d ON d.product_id = l.product_id AND d.event_id = l.event_id)"""

PEVENTS = """
pe0 AS (
  SELECT product_id, 'PRODUCT_CREATED' AS eventType, ts AS occurredAt, event_id * 2 AS seq,
         300 AS stockQuantity, CAST(NULL AS INTEGER) AS stockDelta
  FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ts, event_id) AS rn FROM deltas)
  WHERE rn = 1
  UNION ALL
  SELECT product_id, 'STOCK_ADJUSTED', ts, event_id * 2 + 1, CAST(balance AS INTEGER), CAST(delta AS INTEGER)
  FROM ledger_ts WHERE accepted
  UNION ALL
  SELECT product_id, 'PRODUCT_CREATED', created_at, 0, stock_quantity, NULL FROM products
  WHERE product_id NOT IN (SELECT product_id FROM deltas)
  UNION ALL
  SELECT product_id, 'PRODUCT_DELETED', created_at + INTERVAL 60 DAY, 1, stock_quantity, NULL
  FROM products JOIN part ON p_partkey = product_id AND p_size = 50
  WHERE product_id NOT IN (SELECT product_id FROM deltas)),
pevents AS (
  SELECT e.product_id AS productId, e.eventType, coalesce(p.sku, printf('SKU-%06d', e.product_id)) AS sku,
         p.category, p.price, CAST(e.stockQuantity AS INTEGER) AS stockQuantity, e.stockDelta, e.occurredAt, e.seq
  FROM pe0 e LEFT JOIN products p USING (product_id))"""

PE = [PRODUCTS, DELTAS, LEDGER, LEDGER_TS, PEVENTS]
PE_COLS = ("productId, eventType, sku, category, CAST(price AS DOUBLE) AS price, stockQuantity, "
           "stockDelta, occurredAt")


def _jstr(x: str) -> str:
    return f"coalesce(to_json({x}), 'null')"


def _jnum(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'null')"


def _jts(x: str) -> str:
    return f"""coalesce('"' || strftime({x}, '%Y-%m-%dT%H:%M:%S.%fZ') || '"', 'null')"""


sql("sink_product_events", with_(*PE) + f"""
SELECT CAST(productId AS VARCHAR) AS key,
       '{{"eventType":' || {_jstr('eventType')} || ',"productId":' || {_jstr('CAST(productId AS VARCHAR)')}
       || ',"sku":' || {_jstr('sku')} || ',"category":' || {_jstr('category')}
       || ',"stockQuantity":' || {_jnum('stockQuantity')} || ',"stockDelta":' || {_jnum('stockDelta')}
       || ',"price":' || {_jnum('price')} || ',"occurredAt":' || {_jts('occurredAt')}
       || ',"eventSeq":' || {_jnum('seq')} || '}}' AS value
FROM pevents""")
sql("src_product_events", with_(*PE) + """
SELECT eventType, CAST(productId AS VARCHAR) AS productId, sku, category, stockQuantity,
       CAST(stockDelta AS DOUBLE) AS stockDelta,
       CAST(price AS DOUBLE) AS price, occurredAt, seq AS eventSeq FROM pevents""")
sql("downward_adjustments", with_(*PE) + f"""
SELECT {PE_COLS} FROM pevents WHERE eventType = 'STOCK_ADJUSTED' AND stockDelta < 0""")
sql("out_of_stock_signals", with_(*PE) + f"""
SELECT {PE_COLS} FROM pevents WHERE eventType = 'STOCK_ADJUSTED' AND stockQuantity = 0""")
sql("product_deleted_signals", with_(*PE) + f"SELECT {PE_COLS} FROM pevents WHERE eventType = 'PRODUCT_DELETED'")

# ------------------------------------------------------------ order events
OEVENTS = """
oitems AS (
  SELECT order_id,
         '[' || string_agg('{"productId":"' || CAST(product_id AS VARCHAR) || '","sku":' || to_json(sku)
                           || ',"quantity":' || CAST(quantity AS VARCHAR) || ',"unitPrice":'
                           || CAST(unit_price AS VARCHAR) || '}', ','
                           ORDER BY product_id, sku, quantity, unit_price) || ']' AS items_json,
         count(*) AS n_items, CAST(sum(CAST(unit_price * quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total
  FROM items GROUP BY order_id),
oevents AS (
  SELECT p.e AS eventType, o.id AS orderId, o.customer_id AS customerId, coalesce(i.items_json, '[]') AS items_json,
         coalesce(i.n_items, 0) AS n_items, coalesce(i.total, CAST(0 AS DECIMAL(18,2))) AS total,
         p.after AS status, o.updated_at AS occurredAt
  FROM orders_m o
  JOIN (VALUES ('ORDER_PLACED', 'PENDING', ['PENDING', 'CONFIRMED', 'SHIPPED', 'DELIVERED', 'CANCELLED']),
               ('ORDER_CONFIRMED', 'CONFIRMED', ['CONFIRMED', 'SHIPPED', 'DELIVERED']),
               ('ORDER_SHIPPED', 'SHIPPED', ['SHIPPED', 'DELIVERED']),
               ('ORDER_CANCELLED', 'CANCELLED', ['CANCELLED'])) p(e, after, passed) ON list_contains(p.passed, o.status)
  LEFT JOIN oitems i ON i.order_id = o.id)"""

sql("sink_order_events", with_(ORDERS_M, ITEMS, OEVENTS) + f"""
SELECT CAST(orderId AS VARCHAR) AS key,
       '{{"eventType":' || {_jstr('eventType')} || ',"orderId":' || {_jstr('CAST(orderId AS VARCHAR)')}
       || ',"customerId":' || {_jstr('CAST(customerId AS VARCHAR)')} || ',"items":' || items_json
       || ',"total":' || {_jnum('total')} || ',"status":' || {_jstr('status')}
       || ',"occurredAt":' || {_jts('occurredAt')} || '}}' AS value
FROM oevents""")
sql("src_order_events", with_(ORDERS_M, ITEMS, OEVENTS) + """
SELECT eventType, CAST(orderId AS VARCHAR) AS orderId, CAST(customerId AS VARCHAR) AS customerId,
       CAST(n_items AS INTEGER) AS n_items, CAST(total AS DOUBLE) AS total, status, occurredAt FROM oevents""")
sql("confirmed_orders", with_(ORDERS_M, ITEMS, OEVENTS) + """
SELECT orderId, customerId, CAST(n_items AS INTEGER) AS n_items, CAST(total AS DOUBLE) AS total, occurredAt
FROM oevents WHERE eventType = 'ORDER_CONFIRMED'""")

# ------------------------------------------------------------ forecast events
FEVENTS = """
fev AS (
  SELECT CASE WHEN status = 'COMPLETED' THEN 'FORECAST_COMPLETED' ELSE 'FORECAST_FAILED' END AS eventType,
         id AS jobId, CAST(product_id AS VARCHAR) AS productId, sku, status,
         CASE WHEN status = 'COMPLETED' THEN total_predicted_demand END AS totalPredictedDemand,
         CASE WHEN status = 'COMPLETED' THEN mae END AS mae,
         CASE WHEN status <> 'COMPLETED' THEN error_message END AS errorMessage,
         updated_at AS occurredAt
  FROM jobs_all)"""

sql("sink_forecast_events", with_(*STORE, FEVENTS) + f"""
SELECT productId AS key,
       '{{"eventType":' || {_jstr('eventType')} || ',"jobId":' || {_jstr('jobId')}
       || ',"productId":' || {_jstr('productId')} || ',"sku":' || {_jstr('sku')}
       || ',"status":' || {_jstr('status')} || ',"totalPredictedDemand":' || {_jnum('totalPredictedDemand')}
       || ',"mae":' || {_jnum('mae')} || ',"errorMessage":' || {_jstr('errorMessage')}
       || ',"occurredAt":' || {_jts('occurredAt')} || '}}' AS value
FROM fev""")
sql("src_forecast_events", with_(*STORE, FEVENTS) + """
SELECT eventType, jobId, productId, sku, status, CAST(totalPredictedDemand AS DOUBLE) AS totalPredictedDemand,
       CAST(mae AS DOUBLE) AS mae, errorMessage, occurredAt FROM fev""")
sql("route_events", with_(*STORE, FEVENTS) + """
SELECT jobId, eventType,
       CASE WHEN eventType = 'FORECAST_FAILED' THEN 'failure'
            WHEN eventType = 'FORECAST_COMPLETED' AND totalPredictedDemand IS NOT NULL THEN 'result'
            ELSE 'ignored' END AS route FROM fev""")

# ------------------------------------------------------------ alert rules
LOW_STOCK = """
low_alerts AS (
  SELECT sha256('LOW_STOCK:' || CAST(productId AS VARCHAR) || ':' || CAST(epoch_us(occurredAt) AS VARCHAR) || ':'
                || CAST(stockQuantity AS VARCHAR) || ':' || CAST(stockDelta AS VARCHAR) || ':' || CAST(seq AS VARCHAR)) AS id,
         'LOW_STOCK' AS type, CASE WHEN stockQuantity = 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
         productId AS product_id, sku, 'Low Stock Alert: ' || sku AS title,
         printf('Product %s has only %d units remaining (threshold: %d).', sku, stockQuantity, 10) AS message,
         occurredAt AS occurred_at
  FROM pevents WHERE eventType = 'STOCK_ADJUSTED' AND stockDelta < 0 AND stockQuantity <= 10)"""

FULL = [PRODUCTS, HIST, CHECKS, VALID, *FIT, *POINTS, TOTALS, JOBS, DELTAS, LEDGER, RESULTS, ALERTS_SQL,
        LEDGER_TS, PEVENTS, LOW_STOCK, """
alerts_all AS (SELECT * FROM alerts UNION ALL SELECT * FROM low_alerts)"""]
ALERT_COLS = "id, type, severity, product_id, sku, title, message, occurred_at"

sql("alerts_low_stock", with_(PRODUCTS, DELTAS, LEDGER, LEDGER_TS, PEVENTS, LOW_STOCK)
    + f"SELECT {ALERT_COLS} FROM low_alerts")
sql("alerts_demand_surge", with_(*FULL) + f"SELECT {ALERT_COLS} FROM alerts WHERE type = 'DEMAND_SURGE'")
sql("alerts_low_demand", with_(*FULL) + f"SELECT {ALERT_COLS} FROM alerts WHERE type = 'LOW_DEMAND_FORECAST'")
sql("alerts_forecast_failed", with_(*FULL) + f"SELECT {ALERT_COLS} FROM alerts WHERE type = 'FORECAST_FAILED'")
sql("alerts_query", with_(*FULL) + f"SELECT {ALERT_COLS} FROM alerts_all WHERE type = 'DEMAND_SURGE'")
sql("alert_log_lines", with_(*FULL) + """
SELECT id, CASE severity WHEN 'CRITICAL' THEN 'ERROR' WHEN 'WARNING' THEN 'WARN' ELSE 'INFO' END AS level,
       printf('[ALERT] id=%s type=%s severity=%s sku=%s | %s', id, type, severity, sku, message) AS line
FROM alerts_all""")

# ------------------------------------------------------------ validation
sql("validate_products", """
WITH r AS (
  SELECT p_partkey, p_name AS name, upper(replace(p_brand, '#', '-')) AS sku, p_type AS category,
         CAST(p_retailprice - 950 AS DECIMAL(12,2)) AS price, p_size - 10 AS initial_stock FROM part),
e AS (
  SELECT p_partkey, concat_ws(', ',
    CASE WHEN name IS NULL OR trim(name) = '' THEN 'name: name is required' END,
    CASE WHEN sku IS NULL OR trim(sku) = '' THEN 'sku: sku is required' END,
    CASE WHEN sku IS NOT NULL AND NOT regexp_full_match(sku, '^[A-Z0-9\\-]{3,20}$')
         THEN 'sku: SKU must be 3-20 uppercase alphanumeric characters' END,
    CASE WHEN category IS NULL OR trim(category) = '' THEN 'category: category is required' END,
    CASE WHEN price IS NULL THEN 'price: price is required' END,
    CASE WHEN price <= 0 THEN 'price: price must be positive' END,
    CASE WHEN initial_stock < 0 THEN 'initialStock: initialStock cannot be negative' END) AS errors
  FROM r)
SELECT p_partkey, errors = '' AS accepted, errors FROM e""")

sql("validate_stock_deltas", """
SELECT event_id, event_type <> 'error' AS accepted,
       CASE WHEN event_type = 'error' THEN 'delta: delta is required' ELSE '' END AS errors
FROM events""")

sql("validate_orders", with_(ORDERS_M, ITEMS, _faulty("orders", "orders_m", "*"), BAD_ITEMS) + """,
flags AS (
  SELECT order_id, product_id IS NULL AS a, coalesce(trim(sku), '') = '' AS b, coalesce(quantity < 1, false) AS c,
         unit_price IS NULL AS d, coalesce(unit_price < 0.01, false) AS e FROM bad_order_items),
per AS (
  SELECT order_id, count(*) AS n_items, count(*) FILTER (WHERE a OR b OR c OR d OR e) AS n_bad_items, count(*) FILTER (WHERE a) AS a,
         count(*) FILTER (WHERE b) AS b, count(*) FILTER (WHERE c) AS c, count(*) FILTER (WHERE d) AS d, count(*) FILTER (WHERE e) AS e
  FROM flags GROUP BY order_id),
v AS (
  SELECT o.id, coalesce(p.n_items, 0) AS n_items, coalesce(p.n_bad_items, 0) AS n_bad_items,
         concat_ws(', ', CASE WHEN o.customer_id IS NULL THEN 'customerId: must not be null' END,
                   CASE WHEN coalesce(p.n_items, 0) = 0 THEN 'items: Order must have at least one item' END,
                   CASE WHEN a > 0 THEN printf('items.productId: must not be null (%d)', a) END,
                   CASE WHEN b > 0 THEN printf('items.sku: must not be blank (%d)', b) END,
                   CASE WHEN c > 0 THEN printf('items.quantity: must be greater than or equal to 1 (%d)', c) END,
                   CASE WHEN d > 0 THEN printf('items.unitPrice: must not be null (%d)', d) END,
                   CASE WHEN e > 0 THEN printf('items.unitPrice: must be greater than or equal to 0.01 (%d)', e) END) AS errors
  FROM bad_orders o LEFT JOIN per p ON p.order_id = o.id)
SELECT CAST(id AS DOUBLE) AS id, n_items, n_bad_items, errors = '' AS accepted, errors FROM v""")

sql("validate_forecast_requests", with_(HIST) + """
, r AS (SELECT p_partkey AS product_id, printf('SKU-%06d', p_partkey) AS sku, p_size * 8 AS horizon_days FROM part),
v AS (
  SELECT r.product_id, r.horizon_days, concat_ws(', ',
    CASE WHEN r.product_id IS NULL THEN 'productId: must not be null' END,
    CASE WHEN r.sku IS NULL OR trim(r.sku) = '' THEN 'sku: must not be blank' END,
    CASE WHEN r.horizon_days < 1 THEN 'horizonDays: must be greater than or equal to 1' END,
    CASE WHEN r.horizon_days > 365 THEN 'horizonDays: must be less than or equal to 365' END,
    CASE WHEN r.product_id NOT IN (SELECT product_id FROM hist) THEN 'historicalData: must not be empty' END)
    AS errors
  FROM r)
SELECT product_id, horizon_days, errors = '' AS accepted, errors FROM v""".replace("\n\n, r AS", ",\nr AS"))

sql("validate_points", with_(*STORE) + """
SELECT job_id, forecast_date, CAST(predicted_quantity AS DOUBLE) AS predicted_quantity,
       CAST(lower_bound AS DOUBLE) AS lower_bound, CAST(upper_bound AS DOUBLE) AS upper_bound,
       concat_ws(', ', CASE WHEN lower_bound > upper_bound THEN 'lowerBound cannot exceed upperBound' END,
                 CASE WHEN predicted_quantity < 0 THEN 'predictedQuantity cannot be negative' END) AS errors,
       NOT (lower_bound > upper_bound OR predicted_quantity < 0) AS accepted
FROM points_all""")



def _audit() -> str:
    """Every rule by a query of its own."""
    def counts(table, rules):
        return [f"SELECT '{table}' AS table_name, '{r}' AS rule, count(*) FILTER (WHERE {c}) AS violations FROM bad_{table}" for r, c in rules]

    def not_null(*columns):
        return [(f"{c}_not_null", f"{c} IS NULL") for c in columns]

    def longer(**most):
        return [(f"{c}_length_{n}", f"length({c}) > {n}") for c, n in most.items()]

    def unique(table, c):
        return (f"SELECT '{table}', '{c}_unique', CAST(coalesce(sum(n), 0) AS BIGINT) FROM "
                f"(SELECT count(*) AS n FROM bad_{table} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)")

    def orphans(table, rule, c, parent):
        return (f"SELECT '{table}', '{rule}', count(*) FROM bad_{table} x WHERE {c} IS NOT NULL "
                f"AND NOT EXISTS (SELECT 1 FROM bad_{parent} p WHERE p.id = x.{c})")

    parts = counts("products", [
        *not_null("product_id", "name", "sku", "category", "price", "stock_quantity", "created_at", "updated_at", "version"),
        *longer(name=255, sku=50, category=100), ("price_non_negative", "price < 0"), ("stock_non_negative", "stock_quantity < 0")])
    parts += counts("orders", [*not_null("id", "customer_id", "status", "created_at", "updated_at", "version"), *longer(status=20),
                               ("status_allowed", "status NOT IN ('PENDING', 'CONFIRMED', 'SHIPPED', 'DELIVERED', 'CANCELLED')")])
    parts += counts("order_items", [*not_null("order_id", "product_id", "sku", "quantity", "unit_price"), *longer(sku=50),
                                    ("quantity_positive", "quantity <= 0"), ("unit_price_non_negative", "unit_price < 0")])
    parts += counts("forecast_jobs", [
        *not_null("id", "product_id", "sku", "horizon_days", "status", "created_at", "updated_at", "version"),
        *longer(sku=50, status=20, model_used=50, error_message=1000),
        ("status_allowed", "status NOT IN ('PENDING', 'RUNNING', 'COMPLETED', 'FAILED')"), ("horizon_range", "horizon_days NOT BETWEEN 1 AND 365")])
    parts += counts("forecast_points", [*not_null("job_id", "forecast_date", "predicted_quantity", "lower_bound", "upper_bound"),
                                        ("predicted_non_negative", "predicted_quantity < 0")])
    parts += counts("alerts", [*not_null("id", "type", "severity", "product_id", "sku", "title", "message", "occurred_at"),
                               *longer(type=30, severity=20, product_id=255, sku=50, title=255)])
    parts += [unique("products", "product_id"), unique("products", "sku"), unique("orders", "id"), unique("forecast_jobs", "id"), unique("alerts", "id"),
              orphans("order_items", "order_fk", "order_id", "orders"), orphans("forecast_points", "job_fk", "job_id", "forecast_jobs")]
    return "\nUNION ALL ".join(parts)


sql("audit_constraints", with_(
    *dict.fromkeys([*STORE, *FULL]), _faulty("products", "products", "*"), _faulty("orders", "orders_m", "*"), _faulty("order_items", "items", "*"),
    BAD_JOBS, _faulty("forecast_points", "points_all", "*"), _faulty("alerts", "alerts_all", "*")) + _audit())

# ------------------------------------------------------------ writes
sql("upsert_products", with_(PRODUCTS, INCOMING) + """
, upd AS (
  SELECT p.product_id, p.name, p.sku, p.category, CAST(p.price + 1 AS DECIMAL(12,2)) AS price,
         CAST(t.p_size AS INTEGER) AS stock_quantity, TIMESTAMP '2024-03-01 00:00:00' AS created_at,
         TIMESTAMP '2024-03-01 00:00:00' AS updated_at
  FROM products p JOIN part t ON t.p_partkey = p.product_id WHERE t.p_size > 25
  UNION ALL SELECT * FROM incoming)
SELECT coalesce(i.product_id, s.product_id) AS product_id,
       CASE WHEN i.product_id IS NOT NULL THEN i.name ELSE s.name END AS name,
       CASE WHEN i.product_id IS NOT NULL THEN i.sku ELSE s.sku END AS sku,
       CASE WHEN i.product_id IS NOT NULL THEN i.category ELSE s.category END AS category,
       CAST(CASE WHEN i.product_id IS NOT NULL THEN i.price ELSE s.price END AS DOUBLE) AS price,
       CASE WHEN i.product_id IS NOT NULL THEN i.stock_quantity ELSE s.stock_quantity END AS stock_quantity,
       coalesce(s.created_at, i.created_at) AS created_at,
       CASE WHEN i.product_id IS NOT NULL THEN i.updated_at ELSE s.updated_at END AS updated_at,
       CASE WHEN i.product_id IS NOT NULL AND s.product_id IS NOT NULL THEN s.version + 1
            WHEN i.product_id IS NOT NULL THEN 0 ELSE s.version END AS version
FROM products s FULL OUTER JOIN upd i ON s.product_id = i.product_id""".replace("\n\n, upd", ",\nupd"))

sql("upsert_orders", with_(ORDERS_M, ITEMS) + """
, changed AS (
  SELECT id, customer_id, 'SHIPPED' AS status, created_at, updated_at + INTERVAL 1 DAY AS updated_at
  FROM orders_m WHERE status = 'CONFIRMED'),
incoming AS (
  SELECT * FROM changed
  UNION ALL SELECT 100000000 + c_custkey, c_custkey, 'PENDING', TIMESTAMP '2024-01-01 00:00:00',
                   TIMESTAMP '2024-01-01 00:00:00' FROM customer WHERE c_mktsegment = 'BUILDING'),
new_items AS (
  SELECT order_id, product_id, sku, quantity, unit_price FROM items WHERE order_id NOT IN (SELECT id FROM changed)
  UNION ALL SELECT order_id, product_id, sku, quantity + 1, unit_price FROM items
            WHERE order_id IN (SELECT id FROM changed)),
o AS (
  SELECT coalesce(i.id, s.id) AS id, coalesce(s.customer_id, i.customer_id) AS customer_id,
         CASE WHEN i.id IS NOT NULL THEN i.status ELSE s.status END AS status,
         coalesce(s.created_at, i.created_at) AS created_at,
         CASE WHEN i.id IS NOT NULL THEN i.updated_at ELSE s.updated_at END AS updated_at,
         CASE WHEN i.id IS NOT NULL AND s.id IS NOT NULL THEN s.version + 2
              WHEN i.id IS NOT NULL THEN 0 ELSE s.version END AS version
  FROM orders_m s FULL OUTER JOIN incoming i ON s.id = i.id)
SELECT o.*, CAST(t.total AS DOUBLE) AS total FROM o
LEFT JOIN (SELECT order_id, CAST(sum(unit_price * quantity) AS DECIMAL(18,2)) AS total
           FROM new_items GROUP BY 1) t ON t.order_id = o.id""".replace("\n\n, changed", ",\nchanged"))

sql("upsert_forecast_jobs", with_(*STORE) + """
, hit AS (SELECT j.*, product_id % 2 = 0 AS done FROM jobs_all j
          WHERE product_id IN (SELECT p_partkey FROM part WHERE p_size > 25))
SELECT j.id, j.product_id, j.sku, j.horizon_days,
       CASE WHEN h.id IS NULL THEN j.status WHEN h.done THEN 'COMPLETED' ELSE 'RUNNING' END AS status,
       CASE WHEN h.done THEN 'linear-trend' ELSE j.model_used END AS model_used,
       CASE WHEN h.done THEN 1.5 ELSE CAST(j.mae AS DOUBLE) END AS mae,
       CASE WHEN h.id IS NULL THEN j.error_message END AS error_message, j.created_at,
       j.updated_at + INTERVAL 1 HOUR * (CASE WHEN h.id IS NULL THEN 0 WHEN h.done THEN 2 ELSE 1 END) AS updated_at,
       j.version + CASE WHEN h.id IS NULL THEN 0 WHEN h.done THEN 2 ELSE 1 END AS version
FROM jobs_all j LEFT JOIN hit h ON h.id = j.id
UNION ALL
SELECT 'new-' || id, product_id, sku, horizon_days, 'COMPLETED', 'linear-trend', 1.5, NULL, created_at,
       updated_at + INTERVAL 2 HOUR, 0 FROM hit WHERE product_id % 10 = 0""".replace("\n\n, hit", ",\nhit"))

sql("replace_forecast_points", with_(*STORE) + """
SELECT p.job_id, p.forecast_date,
       CAST(CASE WHEN j.status = 'COMPLETED' AND j.product_id % 2 = 0 THEN p.predicted_quantity * 2 ELSE p.predicted_quantity END AS DOUBLE)
         AS predicted_quantity,
       CAST(p.lower_bound AS DOUBLE) AS lower_bound, CAST(p.upper_bound AS DOUBLE) AS upper_bound
FROM points_all p JOIN jobs_all j ON j.id = p.job_id""")

sql("forecast_responses", with_(PRODUCTS, HIST, VALID, *FIT, *POINTS) + """
SELECT p.product_id, r.sku, 'linear-trend' AS model_used, m.mae, CAST(0.95 AS DOUBLE) AS confidence_interval,
       p.date, p.predicted_quantity, p.lower_bound, p.upper_bound
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date) AS i FROM pts) p
JOIN model m ON m.product_id = p.product_id JOIN products r ON r.product_id = p.product_id WHERE p.i <= 7""")

sql("versioned_update", with_(PRODUCTS) + """
, u AS (SELECT l_partkey AS product_id, l_orderkey * 100 + l_linenumber AS update_id, l_shipdate AS ts,
               CAST(0 AS BIGINT) AS version FROM lineitem),
w AS (SELECT u.product_id, min({'t': u.ts, 'u': u.update_id}) AS win
      FROM u JOIN products p ON p.product_id = u.product_id AND p.version = u.version GROUP BY 1)
SELECT u.product_id, u.update_id, u.ts, u.version AS read_version,
       CASE WHEN p.product_id IS NULL THEN 'UNKNOWN_ID'
            WHEN w.win IS NOT NULL AND w.win = {'t': u.ts, 'u': u.update_id} THEN 'ACCEPTED' ELSE 'STALE' END
         AS outcome,
       CAST(CASE WHEN w.win IS NOT NULL AND w.win = {'t': u.ts, 'u': u.update_id} THEN p.version + 1 END
            AS DOUBLE) AS new_version
FROM u LEFT JOIN products p ON p.product_id = u.product_id LEFT JOIN w ON w.product_id = u.product_id""".replace(
    "\n\n, u AS", ",\nu AS"))

# ------------------------------------------------------------ streaming twins (= batch results)
ORACLE["stream_stock_ledger"] = ORACLE["stock_ledger"]
ORACLE["stream_low_stock"] = ORACLE["alerts_low_stock"]
ORACLE["stream_forecast_alerts"] = ORACLE["all_alerts"]
ORACLE["stream_forecast_alerts_stateful"] = ORACLE["all_alerts"]
sql("rejected_records", with_(*PE) + """
SELECT productId AS product_id, count(*) FILTER (WHERE productId % 11 NOT IN (3, 4, 5)) AS n_parsed,
       count(*) FILTER (WHERE productId % 11 IN (3, 4, 5)) AS n_rejected
FROM pevents GROUP BY productId""")
ORACLE["stream_rejected_records"] = ORACLE["rejected_records"]
ORACLE["stream_daily_demand"] = ORACLE["daily_demand"]
ORACLE["stream_forecast_refresh"] = ORACLE["forecast_points"]
ORACLE["upsert_products_in_buckets"] = ORACLE["upsert_products"]
ORACLE["upsert_orders_in_buckets"] = ORACLE["upsert_orders"]
sql("stream_order_forecast_jobs", with_(*STORE) + """
SELECT j.id, j.product_id, j.sku, j.horizon_days, j.status, j.model_used, CAST(j.mae AS DOUBLE) AS mae, j.error_message,
       CAST(j.total_predicted_demand AS DOUBLE) AS total_predicted_demand, j.created_at, j.updated_at
FROM jobs_all j WHERE j.id IN (SELECT sha256('item:' || CAST(order_id AS VARCHAR) || ':' || item_key) FROM conf_items)""")
ORACLE["stream_order_forecasts"] = ORACLE["forecast_per_confirmed_item"]
sql("stream_dedup_events", "SELECT event_id, ts, user_id, event_type, value FROM events")

_FIELD = """'{{"title":"{t}","value":' || coalesce(to_json({v}), 'null') || ',"short":true}}'"""
sql("alert_webhook_payload", with_(*FULL) + """
SELECT id,
       '{"text":' || to_json('*' || severity || '* — ' || title || chr(10) || message)
       || ',"attachments":[{"color":' || coalesce(to_json(CASE severity WHEN 'CRITICAL' THEN '#FF0000'
            WHEN 'WARNING' THEN '#FFA500' WHEN 'INFO' THEN '#36A64F' END), 'null')
       || ',"fields":[' || """ + " || ',' || ".join([
    _FIELD.format(t="Type", v="type"), _FIELD.format(t="Severity", v="severity"),
    _FIELD.format(t="SKU", v="sku"),
    _FIELD.format(t="Time", v="strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(occurred_at) % 1000000 = 0 THEN '' WHEN epoch_us(occurred_at) % 1000 = 0 THEN strftime(occurred_at, '.%g') ELSE strftime(occurred_at, '.%f') END || 'Z'")]) + """
       || ']}]}' AS payload
FROM alerts_all""")


ORACLE["append_alerts"] = with_(*FULL) + f"SELECT {ALERT_COLS} FROM alerts_all"
ORACLE["alert_fanout"] = ORACLE["alert_log_lines"]

sql("forecast_job_transitions", with_(PRODUCTS, HIST, CHECKS) + """
SELECT sha256('job:' || CAST(product_id AS VARCHAR)) AS job_id,
       CASE WHEN failure_reason IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status,
       CAST(2 AS BIGINT) AS n_events, CAST(2 AS BIGINT) AS n_accepted, CAST(0 AS BIGINT) AS n_refused,
       CAST(TIMESTAMP '2024-01-10 12:00:00' + to_days(CAST(product_id % 15 AS INTEGER)) AS TIMESTAMP) AS last_change
FROM checks""")

sql("forecast_custom_model", with_(HIST, VALID) + """
, stats AS (
  SELECT product_id, max(ds) AS last_ds, avg(y) AS m FROM valid GROUP BY product_id),
sd AS (
  SELECT v.product_id, sqrt(avg((v.y - s.m) * (v.y - s.m))) AS sd
  FROM valid v JOIN stats s USING (product_id) GROUP BY v.product_id),
steps AS (
  SELECT s.product_id, s.last_ds, s.m, d.sd, unnest(range(1, 31)) AS step FROM stats s JOIN sd d USING (product_id))
SELECT product_id, CAST(last_ds + CAST(step AS INTEGER) AS DATE) AS date,
       round_even(m * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE AS predicted_quantity,
       greatest(0.0::DOUBLE, round_even((m - sd) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE) AS lower_bound,
       round_even((m + sd) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE AS upper_bound
FROM steps""".replace("\n\n, stats", ",\nstats"))
sql("validate_order_items", with_(ITEMS) + """
, k AS (
  SELECT order_id, product_id, sku, quantity, unit_price,
         concat_ws(':', CAST(product_id AS VARCHAR), sku, CAST(quantity AS VARCHAR), CAST(unit_price AS VARCHAR),
                   CAST(row_number() OVER (PARTITION BY order_id, product_id, sku, quantity, unit_price) - 1
                        AS VARCHAR)) AS item_key
  FROM items),
e AS (
  SELECT order_id, item_key, concat_ws(', ',
    CASE WHEN product_id IS NULL THEN 'productId: must not be null' END,
    CASE WHEN sku IS NULL OR trim(sku) = '' THEN 'sku: must not be blank' END,
    CASE WHEN quantity < 1 THEN 'quantity: must be greater than or equal to 1' END,
    CASE WHEN unit_price IS NULL THEN 'unitPrice: must not be null' END,
    CASE WHEN unit_price < 0.01 THEN 'unitPrice: must be greater than or equal to 0.01' END) AS errors
  FROM k)
SELECT order_id, item_key, errors = '' AS accepted, errors FROM e""".replace("\n\n, k AS", ",\nk AS"))

# ------------------------------------------------------------ registry boundary
# calendar-day columns of each query, handed over as midnight timestamps
DATE_COLUMNS = {
    "daily_demand": ["ds"], "stream_daily_demand": ["ds"], "series_index": ["ds"], "train_val_split": ["ds"], "seed_history": ["ds"],
    "forecast_points": ["date"], "forecast_responses": ["date"], "stream_forecast_refresh": ["date"], "forecast_per_confirmed_item": ["date"], "stream_order_forecasts": ["date"],
    "jobs_with_points": ["forecast_date"], "validate_points": ["forecast_date"], "replace_forecast_points": ["forecast_date"],
    "forecast_custom_model": ["date"],
}


def dates_as_timestamps_sql(name: str, text: str) -> str:
    cols = DATE_COLUMNS.get(name)
    if not cols:
        return text
    repl = ", ".join(f"CAST({c} AS TIMESTAMP) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({repl}) FROM (\n{text}\n) AS q"
