"""The raw invoice-line schema and the canonical column names."""

from pyspark.sql import types as T

# The eight raw column names, in source order.
RAW_COLUMNS = [
    "invoice_no",
    "stock_code",
    "description",
    "quantity",
    "invoice_date",
    "unit_price",
    "customer_id",
    "country",
]

# Zone-less timestamps: a session time zone must never move a sale to another day.
# Prices are decimal(12,2), so a CSV value of 0.001 is rounded at parse time.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("invoice_no", T.StringType(), True),
        T.StructField("stock_code", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
        T.StructField("quantity", T.IntegerType(), True),
        T.StructField("invoice_date", T.TimestampNTZType(), True),
        T.StructField("unit_price", T.DecimalType(12, 2), True),
        T.StructField("customer_id", T.StringType(), True),
        T.StructField("country", T.StringType(), True),
    ]
)
