"""The driver's tables in the roles of media tables.

events are packets, frames and audio steps of a video per user; lineitem is clip scores (a stratum per return flag and status) and
probes (a title per part); embeddings are thumbnails in order of vec_id within a label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY, HOUR = 86_400_000_000_000, 3_600_000_000_000
FRAME = 40_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, pos, pts, dts, dur, size, key, event_type, value; times in ns, read from the clock's fields so that no time zone matters."""
    micros = F.expr("unix_date(CAST(ts AS DATE)) * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L + CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT)")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("pos"), (micros * 1000).alias("pts"), F.lit(FRAME).cast("long").alias("dur"), F.round(F.col("value") * 100).cast("long").alias("size"), (F.col("event_type") == "signup").alias("key"), "event_type", "value")


def with_end(p: DataFrame) -> DataFrame:
    end = p.groupBy("video_id").agg((F.max("pts") + FRAME).alias("end"))
    return p.join(end, "video_id")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio steps: the energy is value / 1e5, the channels are value - 50 and value - 40 (inverted for errors)."""
    p = packets(spark, sf_dir)
    return p.withColumns({"energy": F.col("value") / 1e5, "left": F.col("value") - 50, "right": F.when(F.col("event_type") == "error", 50 - F.col("value")).otherwise(F.col("value") - 40)})


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of part-year videos: stratum by return flag and status, a slot each line; sampled where the order key is divisible by 3."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_suppkey") % 20).alias("video_id"), F.concat("l_returnflag", "l_linestatus").alias("stratum"), (F.col("l_extendedprice") / 1000).alias("mean"), F.col("l_quantity").cast("int").alias("frames"), (F.col("l_orderkey") % 3 == 0).alias("scored"), "l_orderkey", "l_linenumber")


def strata(c: DataFrame) -> DataFrame:
    return c.groupBy("video_id", "stratum").agg(F.sum("frames").alias("frames"), F.count("*").alias("slots"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title per part, its heights by ship month, bitrate by price, quality rising with it and wavering by quantity; one probe a bitrate."""
    li = table(spark, sf_dir, "lineitem")
    height = F.element_at(F.array(*[F.lit(x) for x in (360, 720, 1080)]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    q = F.lit(100.0) * (1 - F.exp(-F.col("bitrate") / (F.col("height") * 40.0))) - F.col("l_quantity") / 20
    p = li.select(F.col("l_partkey").alias("title"), height.alias("height"), F.round(F.col("l_extendedprice")).cast("long").alias("bitrate"), "l_quantity")
    return p.withColumn("vmaf", F.round(q, 4)).groupBy("title", "height", "bitrate").agg(F.max("vmaf").alias("vmaf"))
