"""Fixed values and rule configuration.

Everything here must equal the behaviour being reproduced: thresholds,
alert texts, colours, status names, the forecast model constants.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AlertThresholds:
    """Alert rule configuration (low stock, low demand, surge multiplier)."""

    low_stock: int = 10
    low_demand: int = 5
    surge_multiplier: float = 2.0


DEFAULT_THRESHOLDS = AlertThresholds()

# --- fixed values: status names -------------------------------------------
ORDER_STATUSES = ("PENDING", "CONFIRMED", "SHIPPED", "DELIVERED", "CANCELLED")
JOB_STATUSES = ("PENDING", "RUNNING", "COMPLETED", "FAILED")
ALERT_TYPES = ("LOW_STOCK", "DEMAND_SURGE", "LOW_DEMAND_FORECAST", "FORECAST_FAILED")
ALERT_SEVERITIES = ("CRITICAL", "WARNING", "INFO")

# --- fixed values: event type names ---------------------------------------
PRODUCT_EVENT_TYPES = ("PRODUCT_CREATED", "STOCK_ADJUSTED", "PRODUCT_DELETED")
ORDER_EVENT_TYPES = ("ORDER_PLACED", "ORDER_CONFIRMED", "ORDER_SHIPPED", "ORDER_CANCELLED")
FORECAST_EVENT_TYPES = ("FORECAST_COMPLETED", "FORECAST_FAILED")

# --- fixed values: alert texts (printf style) -----------------------------
LOW_STOCK_TITLE = "Low Stock Alert: %s"
LOW_STOCK_MESSAGE = "Product %s has only %d units remaining (threshold: %d)."
SURGE_TITLE = "Demand Surge Alert: %s"
SURGE_MESSAGE = ("Forecast predicts %d units demand over next 30 days, "
                 "but current stock is only %d units (surge threshold: %d). Restock urgently.")
LOW_DEMAND_TITLE = "Low Demand Forecast: %s"
LOW_DEMAND_MESSAGE = ("Forecast predicts only %d units demand over next 30 days. "
                      "Consider promotions or stock reduction.")
FAILED_TITLE = "Forecast Failed: %s"
FAILED_MESSAGE = "Demand forecast for %s failed: %s"

# --- fixed values: order transition refusals ------------------------------
MSG_CONFIRM = "Only PENDING orders can be confirmed. Current: "
MSG_SHIP = "Only CONFIRMED orders can be shipped. Current: "
MSG_DELIVER = "Only SHIPPED orders can be delivered. Current: "
MSG_CANCEL_LATE = "Cannot cancel an order that is already "
MSG_CANCEL_TWICE = "Order is already cancelled"

# --- fixed values: forecast job transition refusals -----------------------
MSG_JOB_START = "Only PENDING jobs can be started. Current: "
MSG_JOB_COMPLETE = "Only RUNNING jobs can be completed. Current: "
MSG_JOB_FAIL = "Only RUNNING jobs can fail. Current: "

# --- fixed values: stock refusal -------------------------------------------
MSG_STOCK_BELOW_ZERO = "Cannot reduce stock below zero. Current: %d, Delta: %d"

# --- fixed values: webhook colours and log levels -------------------------
SEVERITY_COLOURS = {"CRITICAL": "#FF0000", "WARNING": "#FFA500", "INFO": "#36A64F"}
SEVERITY_LOG_LEVELS = {"CRITICAL": "ERROR", "WARNING": "WARN", "INFO": "INFO"}
LOG_LINE = "[ALERT] id=%s type=%s severity=%s sku=%s | %s"

# --- fixed values: forecast model ------------------------------------------
MODEL_NAME = "prophet"            # the only accepted request model
MODEL_USED = "linear-trend"       # what the built-in model reports
MIN_HISTORY = 14
MIN_HORIZON, MAX_HORIZON, DEFAULT_HORIZON = 1, 365, 30
TRAIN_FRACTION = 0.8
STD_FLOOR = 0.5
STD_FRACTION = 0.15
Z_95 = 1.96
CONFIDENCE = 0.95
SEED_HISTORY_DAYS = 30

# --- fixed values: product request rules -----------------------------------
SKU_PATTERN = r"\A[A-Z0-9\-]{3,20}\z"

# --- stand-in stock for forecast alerts when no stock is known -------------
DEFAULT_CURRENT_STOCK = 100
