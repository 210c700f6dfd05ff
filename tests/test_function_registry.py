import pytest
from pyspark.sql import functions as F

from lodestone.functions import registry as R


def test_cleaning(spark):
    seen, c = [], R.Cleaning()
    c.register("trim")(lambda df: df.withColumn("x", F.trim("x")))
    c.register("drop")(lambda df: df.where("x <> ''"))
    c.before.append(lambda name, df: seen.append(name) or df)
    df = spark.createDataFrame([(" a ",), ("  ",)], "x string")
    assert [r["x"] for r in c.run(df).collect()] == ["a"] and seen == ["trim", "drop"]
    assert c.run(df, skip=["drop"]).count() == 2
    with pytest.raises(ValueError):
        c.register("trim")(lambda df: df)
    with pytest.raises(KeyError):
        c.run(df, ["no"])


def test_metrics_and_labels(spark):
    m = R.Metrics()
    m.register("error", higher_is_better=False)(lambda: F.avg("e"))
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.5)], "k string, e double")
    assert m.best(m.evaluate(df, ["k"]), "k", "error").first()["k"] == "b"
    labels = R.Labels()
    assert labels.rename(df, "k").count() == 0
    labels.register("a", "Alpha")
    assert {r["k"] for r in labels.rename(df, "k").collect()} == {"Alpha"}
    assert {r["k"] for r in labels.rename(df, "k", drop_unknown=False).collect()} == {"Alpha", "b"}
    with pytest.raises(ValueError):
        labels.register("a", "Other")


def test_read_only(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert R.read_only_sql(spark, "with t as (select id from three) select sum(id) s from t where id > 0").first()["s"] == 3
    for bad in ("drop view three", "create table x as select 1", "insert into three values (1)", "set a=b", "select 1 " + " " * 9000):
        with pytest.raises(ValueError):
            R.read_only_sql(spark, bad)
    assert spark.table("three").count() == 3
