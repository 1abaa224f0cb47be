import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tenure.session import spark_session


@pytest.fixture(scope="session")
def spark():
    s = spark_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tx(spark):
    """Small transaction log: (customer, invoice, item, quantity, time, price, country)."""
    rows = [
        (1, "10", "A", 2, "2011-01-01 10:00:00", 5.0, "X"),
        (1, "10", "B", 1, "2011-01-01 10:00:00", 10.0, "X"),
        (1, "11", "A", 1, "2011-01-01 15:00:00", 7.0, "X"),
        (1, "12", "C", 3, "2011-01-08 09:00:00", 4.0, "X"),
        (2, "20", "A", 1, "2011-02-01 12:00:00", 3.0, "Y"),
        (3, "30", "A", 1, "2011-03-01 23:00:00", 2.0, "Y"),
        (3, "31", "A", 1, "2011-03-02 01:00:00", 2.5, "Y"),
    ]
    return spark.createDataFrame(
        rows, "customer_id long, invoice string, stock_code string, quantity int, t string, price double, country string"
    ).selectExpr("customer_id", "invoice", "stock_code", "stock_code AS description", "quantity",
                 "cast(t AS timestamp) AS invoice_date", "price", "country", "quantity * price AS line_total")
