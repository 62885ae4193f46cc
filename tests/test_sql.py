import pytest

from quernstone.errors import InvalidArgument
from quernstone.sql import sql, translated


def test_series_and_copy(spark, tmp_path):
    text = "SELECT value AS order_id, (value % 100) + 1 AS cust_id, CAST(value % 50 AS DOUBLE) AS total FROM generate_series(1, 20000)"
    assert sql(spark, text).where("cust_id = 7").count() == 200
    done = sql(spark, f"COPY ({text}) TO '{tmp_path}/orders.parquet' STORED AS PARQUET")
    assert done.first()["count"] == 20_000
    assert spark.read.parquet(f"{tmp_path}/orders.parquet").agg({"order_id": "max"}).first()[0] == 20_000
    with pytest.raises(InvalidArgument):
        sql(spark, f"COPY (SELECT 1 AS x) TO '{tmp_path}/x' STORED AS CSV")


def test_literals_stay(spark):
    assert translated("SELECT 'generate_series(1, 2)' AS x FROM t") == "SELECT 'generate_series(1, 2)' AS x FROM t"
    assert sql(spark, "SELECT 'it''s' AS x FROM generate_series(3, 3)").first()[0] == "it's"


def test_settings(spark):
    rows = sql(spark, "SELECT name, value FROM information_schema.df_settings WHERE name LIKE '%session.timeZone'").collect()
    assert [tuple(r) for r in rows] == [("spark.sql.session.timeZone", "UTC")]
