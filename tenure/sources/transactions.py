"""Readers and writers: transaction CSV, parquet intermediates, nested JSON metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType([
    T.StructField("Invoice", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.IntegerType()),
    T.StructField("InvoiceDate", T.TimestampType()),
    T.StructField("Price", T.DoubleType()),
    T.StructField("Customer ID", T.DoubleType()),
    T.StructField("Country", T.StringType()),
])

COLUMN_NAMES = {
    "Invoice": "invoice", "StockCode": "stock_code", "Description": "description",
    "Quantity": "quantity", "InvoiceDate": "invoice_date", "Price": "price",
    "Customer ID": "customer_id", "Country": "country",
}


def read_transactions_csv(spark: SparkSession, path: str,
                          schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Headered transaction CSV with a declared schema (no inference pass)."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def standard_names(df: DataFrame) -> DataFrame:
    """Retail column names to the snake-case names the operators use."""
    return df.withColumnsRenamed(COLUMN_NAMES)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_metrics(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Nested name-to-number objects."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=schema is None)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_parquet(df: DataFrame, path: str, mode: str = "error",
                  partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_metrics(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write a metrics frame as JSON objects, one per row."""
    df.write.mode(mode).json(path)


def nest_metrics(df: DataFrame, **groups: list[str]) -> DataFrame:
    """Group flat metric columns into named structs."""
    return df.select(*[F.struct(*cols).alias(name) for name, cols in groups.items()])


def pack_columns(df: DataFrame, sep: str = ",") -> Column:
    """All columns as one delimited text column."""
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns])
