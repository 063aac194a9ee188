"""Numbers of typed columns are cast, texts of plain digits are parsed at once: the values of the general rule."""

from pyspark.sql import functions as F

from nextbuy.functions import arrays as A
from nextbuy.functions import clean as C
from nextbuy.operators.clean import clean_products
from nextbuy.session import HUGE_METHOD, prepare_session


def test_integer_columns_are_not_parsed_as_text(spark):
    rows = spark.createDataFrame([(1, 1 << 40, None), (None, 0, 5)], "a int, b long, c smallint")
    out = rows.select(*clean_products(rows, ["a", "b", "c"], ["x", "y", "z"]))
    assert [tuple(r) for r in out.collect()] == [(1, 0, 0), (0, 0, 5)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper() and "string" not in plan


def test_plain_digits(spark):
    texts = ["7", "+7", "-0012", "999999999999999999", "9223372036854775807", "9223372036854775808", "2147483648", "1.0", "1e3", " 5 ", "\t5", "", "+", "\x015", "٣"]
    got = spark.createDataFrame([(t,) for t in texts], "v string").select(C.try_integer("v").alias("l"), C.try_integer("v", "int").alias("i")).collect()
    assert [r.l for r in got] == [7, 7, -12, 999999999999999999, 9223372036854775807, None, 2147483648, 1, 1000, 5, 5, None, None, None, None]
    assert [r.i for r in got] == [7, 7, -12, None, None, None, None, 1, 1000, 5, 5, None, None, None, None]


def test_ranks_are_computed_once(spark):
    """Average precision sorts the scores in one place of the plan, not again for each rank."""
    rows = spark.range(3).select(F.array(F.col("id") % 2, F.lit(1), F.lit(0)).alias("y"), F.array(F.rand(1), F.lit(0.5), F.lit(0.1)).alias("p"))
    plan = rows.select(A.ap_at_k("y", "p").alias("ap"), A.binary_crossentropy("y", "p").alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort") + plan.count("arraysort") == 1 and plan.lower().count("ln(") + plan.upper().count("LOG(") <= 2


def test_large_generated_methods_are_split(spark):
    prepare_session(spark)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == HUGE_METHOD["spark.sql.codegen.hugeMethodLimit"]
