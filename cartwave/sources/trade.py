"""Transaction log: explicit schemas, canonical names, one month filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

KEYS = ("user_id", "item_id", "brand_id", "cat_id")

# fixed values: column names of the raw log and their canonical names
RAW_NAMES = {
    "sldatime": "sldat",
    "pluno": "item_id",
    "dptno": "cat_id",
    "bndno": "brand_id",
    "vipno": "user_id",
}


def raw_schema(header: Sequence[str]) -> T.StructType:
    """All-text schema for a log with this header; casts follow in ``canonical``."""
    return T.StructType([T.StructField(h or "_index", T.StringType()) for h in header])


def read_trade_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Read a raw CSV log whose header is ``columns`` (the first one is an index)."""
    raw = spark.read.schema(raw_schema(columns)).csv(path, header=True)
    return canonical(raw.drop(raw.columns[0]))


def canonical(raw: DataFrame) -> DataFrame:
    """Rename, cast and derive; a bad date or number becomes null, a null brand -1."""
    named = raw.withColumnsRenamed({k: v for k, v in RAW_NAMES.items() if k in raw.columns})

    def whole(name: str):
        # brands arrive as "12.0" when the column once held nulls; ids beyond 2^53 have no double of their own
        return F.expr(f"coalesce(try_cast({name} as bigint), try_cast(try_cast({name} as double) as bigint))")

    return with_date_parts(
        named.select(
            whole("user_id").alias("user_id"),
            whole("item_id").alias("item_id"),
            F.coalesce(whole("brand_id"), F.lit(-1).cast("long")).alias("brand_id"),
            whole("cat_id").alias("cat_id"),
            F.expr("try_cast(sldat as timestamp)").alias("sldat"),
            F.expr("try_cast(amt as decimal(18,2))").alias("amt"),
        )
    )


def with_date_parts(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.month("sldat")).withColumn("day", F.dayofmonth("sldat"))


def in_months(trade: DataFrame, months: int | Sequence[int]) -> DataFrame:
    """Rows of these months, of any year."""
    wanted = [months] if isinstance(months, int) else list(months)
    return trade.where(F.col("month").isin(wanted))


# the columns read from the star schema; stated, so that no footer is read to infer them
STAR_SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_extendedprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
    "part": "p_partkey long, p_brand string, p_type string",
    "supplier": "s_suppkey long, s_nationkey int",
    "events": "event_id long, user_id long, ts timestamp_ntz",
}


def star_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def star_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a view over the star schema; one row per line item."""
    line, orders, part = (star_table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(
        part, line.l_partkey == part.p_partkey
    )
    return with_date_parts(
        joined.select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("item_id"),
            F.col("p_brand").alias("brand_id"),
            F.col("p_type").alias("cat_id"),
            F.col("o_orderdate").alias("sldat"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("amt"),
        )
    )
