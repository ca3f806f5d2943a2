"""Business-rule ladders as Column expressions (first matching arm wins).

Thresholds and labels are the reference's fixed values; each ladder takes
its thresholds as keyword parameters with those values as defaults.
``min0`` means ``coalesce(min_stock_level, 0)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.exact import half_up_ratio

# ---------------------------------------------------------------------------
# Fixed values (labels and thresholds that must equal the reference's)
# ---------------------------------------------------------------------------
OUT_OF_STOCK = "OUT OF STOCK"
LOW_STOCK = "LOW STOCK"
ADEQUATE = "ADEQUATE"
HIGH_STOCK = "HIGH STOCK"
STOCK_LOW_BELOW = 30
STOCK_ADEQUATE_BELOW = 100

PRIORITY_EMERGENCY = "1-EMERGENCY"
PRIORITY_CRITICAL = "2-CRITICAL - OUT OF STOCK"
PRIORITY_HIGH = "3-HIGH - VERY LOW"
PRIORITY_MEDIUM = "4-MEDIUM - LOW STOCK"
PRIORITY_NORMAL = "5-NORMAL"
VERY_LOW_BELOW = 10

ACTION_URGENT = "URGENT - ORDER IMMEDIATELY"
ACTION_TODAY = "ORDER TODAY"
ACTION_WEEK = "ORDER THIS WEEK"
ACTION_MONITOR = "MONITOR"

RISK_NO_DATE = "NO EXPIRY DATE"
RISK_CRITICAL = "CRITICAL - SELL NOW"
RISK_HIGH = "HIGH - URGENT"
RISK_MEDIUM = "MEDIUM - PLAN DISCOUNT"
RISK_LOW = "LOW - SAFE"
RISK_EXPIRED = "EXPIRED"
DISCOUNT_50 = "50% DISCOUNT"
DISCOUNT_30 = "30% DISCOUNT"
DISCOUNT_20 = "20% DISCOUNT"
DISCOUNT_NONE = "NO DISCOUNT NEEDED"
EXPIRY_CRITICAL_DAYS = 7
EXPIRY_HIGH_DAYS = 15
EXPIRY_MEDIUM_DAYS = 30

EMERGENCY_DEFAULT_MIN = 30
EMERGENCY_DEFAULT_REQUIRED = 60
EMERGENCY_DEFAULT_REORDER = 50
EMERGENCY_CRITICAL = "🔴 CRITICAL - OUT OF STOCK"
EMERGENCY_BELOW_NORMAL = "🟠 EMERGENCY - BELOW NORMAL"
EMERGENCY_WARNING = "🟡 WARNING - BELOW EMERGENCY LEVEL"
EMERGENCY_ADEQUATE = "🟢 ADEQUATE"
NO_ACTION = "NO ACTION NEEDED"

FAST_MOVING = "FAST MOVING"
NORMAL_MOVING = "NORMAL MOVING"
SLOW_MOVING = "SLOW MOVING"
VERY_SLOW_MOVING = "VERY SLOW MOVING"
FAST_PER_DAY = 10
NORMAL_PER_DAY = 3
SLOW_PER_DAY = 1
SALES_WINDOW_DAYS = 30

NAME_DEFAULT_MIN = 30
# ---------------------------------------------------------------------------


def _min0(min_level: Column) -> Column:
    return F.coalesce(min_level, F.lit(0))


def stock_status(stock: Column, low_below: int = STOCK_LOW_BELOW,
                 adequate_below: int = STOCK_ADEQUATE_BELOW) -> Column:
    """R1."""
    return (
        F.when(stock == 0, OUT_OF_STOCK)
        .when(stock < low_below, LOW_STOCK)
        .when(stock < adequate_below, ADEQUATE)
        .otherwise(HIGH_STOCK)
    )


def shortage_quantity(stock: Column, min_level: Column) -> Column:
    """R2: units missing to reach the minimum (0 when at or above it)."""
    m = _min0(min_level)
    return F.when(m > stock, m - stock).otherwise(F.lit(0)).cast("bigint")


def stock_percentage(stock: Column, min_level: Column) -> Column:
    """Stock as DECIMAL(5,2) percent of the minimum; 0 without a minimum."""
    return F.when(
        _min0(min_level) > 0, half_up_ratio(stock, min_level, multiplier=100, precision=5)
    ).otherwise(F.lit(0).cast("decimal(5,2)"))


def alert_priority(stock: Column, min_level: Column, emergency: Column,
                   very_low_below: int = VERY_LOW_BELOW) -> Column:
    """R4."""
    return (
        F.when((emergency == 1) & (stock < F.coalesce(min_level * 2, F.lit(0))), PRIORITY_EMERGENCY)
        .when(stock == 0, PRIORITY_CRITICAL)
        .when(stock < very_low_below, PRIORITY_HIGH)
        .when(stock < _min0(min_level), PRIORITY_MEDIUM)
        .otherwise(PRIORITY_NORMAL)
    )


def recommended_action(stock: Column, min_level: Column,
                       very_low_below: int = VERY_LOW_BELOW) -> Column:
    """R5."""
    return (
        F.when(stock == 0, ACTION_URGENT)
        .when(stock < very_low_below, ACTION_TODAY)
        .when(stock < _min0(min_level), ACTION_WEEK)
        .otherwise(ACTION_MONITOR)
    )


def is_low_stock_alert(stock: Column, min_level: Column, emergency: Column) -> Column:
    """Below the minimum, or an emergency item below twice the minimum.

    Both arms use ``coalesce(.., 0)``, so an item without a rule never fires.
    """
    return (stock < _min0(min_level)) | (
        (emergency == 1) & (stock < F.coalesce(min_level * 2, F.lit(0)))
    )


def expiry_risk(days: Column) -> Column:
    """R7 (order kept: a negative day count reads CRITICAL, never EXPIRED)."""
    return (
        F.when(days.isNull(), RISK_NO_DATE)
        .when(days <= EXPIRY_CRITICAL_DAYS, RISK_CRITICAL)
        .when(days <= EXPIRY_HIGH_DAYS, RISK_HIGH)
        .when(days <= EXPIRY_MEDIUM_DAYS, RISK_MEDIUM)
        .when(days > EXPIRY_MEDIUM_DAYS, RISK_LOW)
        .otherwise(RISK_EXPIRED)
    )


def recommended_discount(days: Column) -> Column:
    """R8."""
    return (
        F.when(days <= EXPIRY_CRITICAL_DAYS, DISCOUNT_50)
        .when(days <= EXPIRY_HIGH_DAYS, DISCOUNT_30)
        .when(days <= EXPIRY_MEDIUM_DAYS, DISCOUNT_20)
        .otherwise(DISCOUNT_NONE)
    )


def share_percent(part: Column, total: Column) -> Column:
    """DECIMAL(5,2) percent of a positive total, else 0."""
    return F.when(total > 0, half_up_ratio(part, total, multiplier=100, precision=5)).otherwise(
        F.lit(0).cast("decimal(5,2)")
    )


def emergency_required(min_level: Column) -> Column:
    """E = coalesce(2 * min, 60)."""
    return F.coalesce(min_level * 2, F.lit(EMERGENCY_DEFAULT_REQUIRED))


def emergency_deficit(stock: Column, min_level: Column) -> Column:
    """R11."""
    e = emergency_required(min_level)
    return F.when(stock >= e, F.lit(0)).otherwise(e - stock).cast("bigint")


def emergency_status(stock: Column, min_level: Column) -> Column:
    """R12."""
    return (
        F.when(stock == 0, EMERGENCY_CRITICAL)
        .when(stock < F.coalesce(min_level, F.lit(EMERGENCY_DEFAULT_MIN)), EMERGENCY_BELOW_NORMAL)
        .when(stock < emergency_required(min_level), EMERGENCY_WARNING)
        .otherwise(EMERGENCY_ADEQUATE)
    )


def emergency_rank(stock: Column, min_level: Column) -> Column:
    """The ORDER BY rank behind R12 (1 critical .. 4 adequate)."""
    return (
        F.when(stock == 0, 1)
        .when(stock < F.coalesce(min_level, F.lit(EMERGENCY_DEFAULT_MIN)), 2)
        .when(stock < emergency_required(min_level), 3)
        .otherwise(4)
    )


def action_required(stock: Column, min_level: Column, reorder_quantity: Column) -> Column:
    """R13."""
    qty = F.coalesce(reorder_quantity, F.lit(EMERGENCY_DEFAULT_REORDER)).cast("string")
    return F.when(
        stock < emergency_required(min_level), F.concat(F.lit("ORDER "), qty, F.lit(" UNITS NOW"))
    ).otherwise(NO_ACTION)


def movement_category(units: Column, window_days: int = SALES_WINDOW_DAYS) -> Column:
    """Units / window_days against 10 / 3 / 1 per day (exact integer form)."""
    return (
        F.when(units > FAST_PER_DAY * window_days, FAST_MOVING)
        .when(units > NORMAL_PER_DAY * window_days, NORMAL_MOVING)
        .when(units > SLOW_PER_DAY * window_days, SLOW_MOVING)
        .otherwise(VERY_SLOW_MOVING)
    )


def avg_daily_sales(units: Column, window_days: int = SALES_WINDOW_DAYS) -> Column:
    """Units / window_days as DECIMAL(10,2) (divisor is the window, not days sold)."""
    return half_up_ratio(units, F.lit(window_days), precision=10)


def is_low_stock(stock: Column, min_level: Column) -> Column:
    """R17."""
    return F.when(stock < _min0(min_level), "YES").otherwise("NO")
