"""Stand-in inputs derived from the driver's TPC-H-like tables.

The test data holds no bank snapshots, so the tables below give rows in the
schemas the library expects (see FIXTURES.md section 3). They only shape
input; every operator applied to them runs unchanged on real snapshots.

* ``snapshots``      one row per (customer, month), 24 product flags
* ``raw_orders``     one row per order, dirty text attributes
* ``raw_snapshots``  raw-file schema, one row per (customer, month)
* ``training_log``   (epoch, metric, value)
* ``activations``    (id, vec, label)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import NUM_PRODUCTS, PRODUCT_LABELS, Y_COLS
from .tables import read_table

# Stand-in calendar: orders run from January 1995 (t = 1) to August 2001
# (t = 80, a single day), so month 78 is the last full training month.
STANDIN_BASE_YEAR = 1995
STANDIN_TRAIN_MONTH = 78
STANDIN_TEST_MONTH = 79
STANDIN_LAST_MONTH = 80


def _case_mod(key: Column, n: int, values: dict) -> Column:
    """``CASE key % n WHEN r THEN v ... END`` (unlisted remainders are null)."""
    r = key % n
    expr = None
    for rem, val in values.items():
        expr = F.when(r == rem, F.lit(val)) if expr is None else expr.when(r == rem, F.lit(val))
    return expr


def product_index(brand: Column) -> Column:
    """0-based product index of a part: (brand number - 1) mod 24."""
    return (F.substring(brand, 7, 16).try_cast("int") - 1) % NUM_PRODUCTS


def month_index(ts: Column, base_year: int) -> Column:
    return 12 * (F.year(ts) - base_year) + F.month(ts)


def order_product_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, mask): bit k set when the order holds a part of product k.

    Lineitem is reduced to one row per order here, before it meets orders,
    so the second shuffle moves orders-sized data, not lineitem-sized.
    Spark picks the join strategy for part at run time (broadcast only
    under the size threshold).
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pt = read_table(spark, sf_dir, "part").select("p_partkey", product_index(F.col("p_brand")).alias("k"))
    return (li.join(pt, li.l_partkey == pt.p_partkey)
              .groupBy("l_orderkey")
              .agg(F.bit_or(F.pow(F.lit(2), F.col("k")).cast("int")).alias("mask")))


def flags_from_mask(mask: Column, names=Y_COLS) -> list[Column]:
    return [F.shiftright(F.coalesce(mask, F.lit(0)), i).bitwiseAND(1).alias(n) for i, n in enumerate(names)]


def snapshots(spark: SparkSession, sf_dir: str, base_year: int = STANDIN_BASE_YEAR) -> DataFrame:
    """(id, t, t_month, y_1_saving .. y_24_direct): products per customer-month."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("id"),
        month_index(F.col("o_orderdate"), base_year).alias("t"))
    months = (orders.join(order_product_masks(spark, sf_dir), orders.o_orderkey == F.col("l_orderkey"))
                    .groupBy("id", "t")
                    .agg(F.bit_or("mask").alias("mask")))
    return months.select("id", "t", (F.pmod(F.col("t") - 1, F.lit(12)) + 1).alias("t_month"),
                         *flags_from_mask(F.col("mask")))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # nation and region have a fixed size (25 and 5 rows) at every scale.
    geo = (read_table(spark, sf_dir, "nation")
           .join(F.broadcast(read_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "n_name", "r_name"))
    return customer.join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))


def _orders_with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").join(_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the dirty attribute texts of FIXTURES.md 3.2."""
    k = F.col("o_orderkey")
    return _orders_with_customer(spark, sf_dir).select(
        k.alias("o_orderkey"),
        F.col("o_custkey").alias("id"),
        F.col("o_orderdate").alias("fecha_dato"),
        _case_mod(k, 4, {0: "N", 1: "S", 2: "A"}).alias("ind_empleado"),
        _case_mod(k, 6, {0: "ES", 1: "FR", 2: "DE", 3: "US", 4: "ES"}).alias("pais_residencia"),
        F.when(F.col("o_orderstatus") == "F", "H").when(F.col("o_orderstatus") == "O", "V")
         .otherwise(F.col("o_orderstatus")).alias("sexo"),
        F.when(k % 11 == 0, F.lit(" NA")).otherwise(F.concat(F.lit(" "), (18 + k % 80).cast("string"))).alias("age"),
        F.col("c_acctbal").cast("double").alias("antiguedad"),
        F.when(k % 13 == 0, F.lit(99)).otherwise(F.lit(1)).alias("indrel"),
        _case_mod(k, 7, {0: "1", 1: "1.0", 2: "2.0", 3: "3", 4: "P", 5: "1.0"}).alias("indrel_1mes"),
        F.when(k % 5 == 0, "A").when(k % 5 == 1, "I").when(k % 5 == 2, "P").when(k % 5 == 3, "R")
         .otherwise("N").alias("tiprel_1mes"),
        _case_mod(k, 9, {0: "KAT", 1: "KHE", 2: "RED", 3: "007", 4: "013", 5: "002", 6: "K00", 7: "K"}).alias("canal_entrada"),
        F.col("c_nationkey").alias("cod_prov"),
        F.col("r_name").alias("community"),
        F.col("c_mktsegment").alias("market"),
        F.when(k % 10 == 0, F.lit("         NA")).otherwise(F.floor("o_totalprice").cast("string")).alias("renta"),
        F.col("o_orderpriority").alias("segmento"),
    )


def raw_snapshots(spark: SparkSession, sf_dir: str, base_year: int = STANDIN_BASE_YEAR,
                  with_products: bool = True) -> DataFrame:
    """Rows in the raw snapshot-file schema, one per (customer, month).

    Attributes come from the month's first order (smallest order key);
    the 24 flags are the month's products and are left empty in every
    tenth month so that the zero fill has work to do. The first order is
    chosen over the few source fields; the customer's fields are joined and the
    attribute texts derived afterwards, for the chosen rows only. Orders are dealt by
    customer once, which serves the grouping and the join.
    """
    o = read_table(spark, sf_dir, "orders").filter(F.col("o_custkey").isNotNull())
    if with_products:
        o = o.join(order_product_masks(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    else:
        o = o.withColumn("mask", F.lit(0))
    src = F.struct("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority")
    months = (o.select(F.col("o_custkey").alias("ncodpers"), month_index(F.col("o_orderdate"), base_year).alias("t"),
                       src.alias("a"), F.col("mask"))
               .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ncodpers")
               .groupBy("ncodpers", "t")
               .agg(F.min("a").alias("a"), F.bit_or("mask").alias("mask")))
    # of customer rows with the same key, the least one
    customer = (_customers(spark, sf_dir).groupBy("c_custkey")
                .agg(F.min(F.struct("c_acctbal", "c_nationkey", "n_name")).alias("c")))
    g = (months.join(customer, F.col("ncodpers") == F.col("c_custkey"))
               .select("ncodpers", "t", "mask", "a.*", "c.*"))
    k = F.col("o_orderkey")
    fecha = F.date_format("o_orderdate", "yyyy-MM-dd")
    cols = [
        fecha.alias("fecha_dato"),
        F.col("ncodpers"),
        _case_mod(k, 4, {0: "N", 1: "S", 2: "A"}).alias("ind_empleado"),
        _case_mod(k, 6, {0: "ES", 1: "FR", 2: "DE", 3: "US", 4: "ES"}).alias("pais_residencia"),
        F.when(F.col("o_orderstatus") == "F", "H").when(F.col("o_orderstatus") == "O", "V")
         .otherwise(F.col("o_orderstatus")).alias("sexo"),
        F.when(k % 11 == 0, F.lit(" NA")).otherwise(F.concat(F.lit(" "), (18 + k % 80).cast("string"))).alias("age"),
        fecha.alias("fecha_alta"),
        _case_mod(k, 3, {0: "1", 1: "0"}).alias("ind_nuevo"),
        F.when(k % 23 == 0, F.lit("-999999"))
         .otherwise(F.concat(F.lit("     "), F.floor(F.col("c_acctbal") / 40).cast("string"))).alias("antiguedad"),
        F.when(k % 13 == 0, F.lit(99)).otherwise(F.lit(1)).alias("indrel"),
        F.lit(None).cast("string").alias("ult_fec_cli_1t"),
        _case_mod(k, 7, {0: "1", 1: "1.0", 2: "2.0", 3: "3", 4: "P", 5: "1.0"}).alias("indrel_1mes"),
        F.when(k % 5 == 0, "A").when(k % 5 == 1, "I").when(k % 5 == 2, "P").when(k % 5 == 3, "R")
         .otherwise("N").alias("tiprel_1mes"),
        _case_mod(k, 8, {0: "N", 1: "S", 2: "S", 3: "S", 4: "S", 5: "S", 6: "S"}).alias("indresi"),
        F.when(k % 5 == 0, "S").otherwise("N").alias("indext"),
        F.lit(None).cast("string").alias("conyuemp"),
        _case_mod(k, 9, {0: "KAT", 1: "KHE", 2: "RED", 3: "007", 4: "013", 5: "002", 6: "K00", 7: "K"}).alias("canal_entrada"),
        F.when(k % 17 == 0, "S").otherwise("N").alias("indfall"),
        F.lit(1).alias("tipodom"),
        F.col("c_nationkey").alias("cod_prov"),
        F.col("n_name").alias("nomprov"),
        F.when(k % 19 == 0, F.lit(None).cast("string")).otherwise((k % 2).cast("string")).alias("ind_actividad_cliente"),
        F.when(k % 10 == 0, F.lit("         NA")).otherwise(F.floor("o_totalprice").cast("string")).alias("renta"),
        F.concat(F.lit("0"), F.substring("o_orderpriority", 1, 1), F.lit(" - "),
                 F.substring("o_orderpriority", 3, 32)).alias("segmento"),
    ]
    if with_products:
        empty_month = F.col("t") % 10 == 0
        cols += [F.when(empty_month, F.lit(None).cast("int")).otherwise(c).alias(PRODUCT_LABELS[i])
                 for i, c in enumerate(flags_from_mask(F.col("mask"), PRODUCT_LABELS))]
    return g.select(*cols)


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(epoch, metric, value): event values averaged per day and type; the type ``error`` plays the loss."""
    ev = read_table(spark, sf_dir, "events")
    return (ev.groupBy((F.dayofmonth("ts") - 1).alias("epoch"), F.when(F.col("event_type") == "error", "loss").otherwise(F.col("event_type")).alias("metric"))
              .agg(F.avg("value").alias("value")))


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec, label): one activation vector per example, label = stratum."""
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label"))
