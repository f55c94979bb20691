from pyspark.sql import functions as F

from goldlink.functions import normalize as nz
from goldlink.functions import sql
from tests.test_normalize import DATES, SKILLS


def test_functions_agree_with_the_column_versions(spark):
    assert "normalize_date" in sql.register(spark)
    values = [x for x, _ in DATES + SKILLS] + [" USA ", "in", " A@B.co\t", "+15550001111", "a@b.co"]
    df = spark.createDataFrame([(x,) for x in values], "x string")
    df.createOrReplaceTempView("sql_values")
    got = spark.sql("SELECT x, normalize_date(x) d, normalize_skill(x) s, normalize_country(x) c, normalize_email(x) e, is_e164(x) p, is_email(x) m FROM sql_values").collect()
    want = df.select("x", nz.date(F.col("x")).alias("d"), nz.skill(F.col("x")).alias("s"), nz.country(F.col("x")).alias("c"), F.nullif(nz.email(F.col("x")), F.lit("")).alias("e")).collect()
    assert sorted(map(repr, (tuple(r[:5]) for r in got))) == sorted(map(repr, map(tuple, want)))
    assert [r.x for r in got if r.p] == ["+15550001111"] and [r.x for r in got if r.m] == ["a@b.co"]
    assert "EvalPython" not in spark.sql("SELECT normalize_skill(CAST(id AS STRING)) FROM range(3)")._jdf.queryExecution().executedPlan().toString()
