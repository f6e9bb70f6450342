"""Readers of the tools' outputs: packet lines, first-pass logs, probe JSON, corpus rows; and the writers that match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import NS, bit_depth, dynamic_range, rational


def _ns(c: Column) -> Column:
    return F.round(c.try_cast("decimal(20,9)") * NS).cast("long")


def packets(lines: DataFrame) -> DataFrame:
    """value = "pts_time=0.1|dts_time=0.0|duration_time=0.033|size=1234|flags=K__" to packets; either time stands in for the other, and a line
    without both is an error."""
    m = lines.where("length(trim(value)) > 0").withColumn("m", F.expr("str_to_map(value, '\\\\|', '=')"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    pts, dts = _ns(get("pts_time")), _ns(get("dts_time"))
    known = F.coalesce(pts, dts)
    keep = [c for c in lines.columns if c != "value"]
    return m.select(*keep, F.when(known.isNull(), F.raise_error(F.concat(F.lit("packet without a time: "), "value"))).otherwise(known).cast("long").alias("pts"), F.coalesce(dts, pts).alias("dts"), F.coalesce(_ns(get("duration_time")), F.lit(0)).alias("dur"), F.coalesce(get("size").try_cast("long"), F.lit(0)).alias("size"), F.coalesce(get("flags").contains("K"), F.lit(False)).alias("key"))


def first_pass(lines: DataFrame) -> DataFrame:
    """Lines (seq, value) of "in:0 out:0 type:I q:10.5 tex:100 mv:20 ..." to GOP sums; a GOP begins at type I."""
    m = lines.withColumn("m", F.expr("str_to_map(value, ' ', ':')"))
    n = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)).try_cast("double"), F.lit(0.0))
    gop = F.sum((F.try_element_at("m", F.lit("type")) == "I").cast("int")).over(Window.partitionBy("video_id").orderBy("seq"))
    r = m.select("video_id", "seq", gop.alias("gop"), n("tex").alias("tex"), n("mv").alias("mv"), n("q").alias("q"))
    return r.groupBy("video_id", "gop").agg(F.count("*").alias("frames"), F.sum("tex").alias("tex"), F.sum("mv").alias("mv"), F.avg("q").alias("q"))


PROBE = "struct<streams:array<struct<index:int,codec_name:string,codec_type:string,width:int,height:int,pix_fmt:string,color_range:string,color_transfer:string,avg_frame_rate:string,bits_per_raw_sample:string,duration:string,bit_rate:string,sample_rate:string,channels:int,disposition:struct<`default`:int,attached_pic:int>,side_data_list:array<struct<side_data_type:string>>>>,format:struct<duration:string,bit_rate:string>>"


def probe(documents: DataFrame) -> DataFrame:
    """value = a container probe's JSON to the first picture stream's geometry, rate, depth and range, and the default audio track (first flagged, else 0, else -1)."""
    d = documents.withColumn("j", F.from_json("value", PROBE))
    video = F.get(F.filter("j.streams", lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0)), F.lit(0))
    audio = F.filter("j.streams", lambda s: s["codec_type"] == "audio")
    side = lambda name: F.coalesce(F.exists(video["side_data_list"], lambda x: x["side_data_type"].contains(name)), F.lit(False))
    flagged = F.array_position(F.transform(audio, lambda s: F.coalesce(s["disposition"]["default"], F.lit(0))), 1)
    keep = [c for c in documents.columns if c != "value"]
    return d.select(
        *keep, video["codec_name"].alias("codec"), video["width"].alias("width"), video["height"].alias("height"), rational(video["avg_frame_rate"]).alias("fps"),
        bit_depth(video["bits_per_raw_sample"], video["pix_fmt"]).alias("bits"), dynamic_range(side("DOVI"), video["color_transfer"], side("HDR10+"), side("Mastering")).alias("range"),
        F.coalesce(F.col("j.format.duration").try_cast("double"), F.lit(0.0)).alias("seconds"), F.when(F.size(audio) == 0, -1).when(flagged > 0, flagged.cast("int") - 1).otherwise(0).alias("audio_track"),
    )


CORPUS = "kind string, source string, codec string, preset string, width int, height int, crf double, sourceHeight int, segmentSeconds double, segments int, bits array<bigint>, vmaf array<double>, features map<string,array<double>>, version int, seq bigint"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).json(path)


def corpus_points(rows: DataFrame, codec: str, preset: str) -> DataFrame:
    """Grid rows of one codec and preset, a point measured again replacing the earlier (by seq), a row for each segment."""
    w = Window.partitionBy("source", "height", "crf").orderBy(F.desc("seq"))
    g = rows.where((F.col("kind") == "grid") & (F.col("codec") == codec) & (F.col("preset") == preset)).withColumn("n", F.row_number().over(w)).where("n = 1")
    bad = F.size("bits") != F.size("vmaf")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bits and vmaf differ in length: "), "source"))).otherwise(F.arrays_zip("bits", "vmaf"))
    return g.select("source", "height", "crf", F.posexplode(checked.cast("array<struct<bits:bigint,vmaf:double>>")).alias("segment", "x")).select("source", "height", "crf", "segment", "x.bits", "x.vmaf")


def append_corpus(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def resume(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Wanted corpus rows that were not measured with the same segment count (an unknown count matches any)."""
    keys = ["kind", "source", "codec", "preset", "height", "crf"]
    a, b = wanted.alias("a"), done.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same & (F.col("a.segments").isNull() | F.col("b.segments").isNull() | (F.col("a.segments") == F.col("b.segments"))), "left_anti")


def report_json(df: DataFrame, *by: str) -> DataFrame:
    """One JSON report a group key, ready for write.text."""
    return df.select(*by, F.to_json(F.struct(*df.columns)).alias("value"))
