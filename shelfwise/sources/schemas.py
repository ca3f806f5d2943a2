"""Declared schemas of the five domain tables (never inferred).

Identifiers are BIGINT: at cluster scale the item and supplier key spaces
outgrow a 32-bit integer. Money is DECIMAL(12,2), never DOUBLE.
"""

from pyspark.sql import types as T

ID = T.LongType()
INT = T.IntegerType()
STR = T.StringType()
DATE = T.DateType()
PRICE = T.DecimalType(12, 2)

# Output types shared by every query (and mirrored in the oracle SQL).
MONEY_SUM = T.DecimalType(38, 2)
COUNT = T.LongType()


def _struct(*fields):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


MEDICINES = _struct(
    ("medicine_id", ID),
    ("medicine_name", STR),
    ("category", STR),
    ("therapeutic_class", STR),
    ("manufacturer", STR),
    ("package_size", STR),
    ("unit_type", STR),
    ("is_emergency", INT),
    ("is_refrigerated", INT),
    ("created_date", DATE),
    ("is_active", INT),
)

SUPPLIERS = _struct(
    ("supplier_id", ID),
    ("supplier_name", STR),
    ("contact_person", STR),
    ("phone", STR),
    ("email", STR),
    ("city", STR),
    ("gst_number", STR),
    ("payment_terms", STR),
    ("lead_time_days", INT),
    ("is_active", INT),
)

PURCHASES = _struct(
    ("purchase_id", ID),
    ("medicine_id", ID),
    ("supplier_id", ID),
    ("batch_no", STR),
    ("manufacturing_date", DATE),
    ("expiry_date", DATE),
    ("quantity_purchased", INT),
    ("quantity_remaining", INT),
    ("purchase_price", PRICE),
    ("selling_price", PRICE),
    ("mrp", PRICE),
    ("purchase_date", DATE),
)

SALES = _struct(
    ("sale_id", ID),
    ("medicine_id", ID),
    ("quantity_sold", INT),
    ("selling_price", PRICE),
    ("discount_percent", INT),
    ("sale_date", DATE),
    ("sale_time", STR),
    ("payment_method", STR),
    ("prescription_required", T.BooleanType()),
    ("bill_no", STR),
)

REORDER = _struct(
    ("medicine_id", ID),
    ("min_stock_level", INT),
    ("max_stock_level", INT),
    ("reorder_quantity", INT),
    ("safety_stock_days", INT),
    ("last_updated", DATE),
)

TABLE_SCHEMAS = {
    "medicines_master": MEDICINES,
    "suppliers_master": SUPPLIERS,
    "purchases_transactions": PURCHASES,
    "sales_transactions": SALES,
    "reorder_levels": REORDER,
}

# Columns that queries read: a Parquet table without one of them is refused.
USED_COLUMNS = {
    "medicines_master": [
        "medicine_id", "medicine_name", "category", "therapeutic_class",
        "manufacturer", "is_emergency", "is_refrigerated",
    ],
    "suppliers_master": ["supplier_id", "supplier_name", "city", "lead_time_days"],
    "purchases_transactions": [
        "purchase_id", "medicine_id", "supplier_id", "batch_no",
        "manufacturing_date", "expiry_date", "quantity_purchased",
        "quantity_remaining", "purchase_price", "selling_price", "purchase_date",
    ],
    "sales_transactions": [
        "sale_id", "medicine_id", "quantity_sold", "selling_price",
        "discount_percent", "sale_date", "payment_method",
    ],
    "reorder_levels": [
        "medicine_id", "min_stock_level", "max_stock_level",
        "reorder_quantity", "safety_stock_days",
    ],
}
