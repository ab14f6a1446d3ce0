"""Gold references of paired recordings: a wave file and an XML file of one name, its segments cut to the audio's length."""

from __future__ import annotations

import io
import wave

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from squelch.functions.hashing import parity_split
from squelch.functions.text import WHITE
from squelch.sources.files import listing

#: Names of recordings (station, channel, MHz, date, time) and of clips (number, start and end in ms).
RECORDING = r"^([A-Z0-9]{4})_(.+?)_(\d+(?:_\d+)?)MHz_(\d{8})_(\d{6})$"
CLIP = r"^(\d{2,})_(\d+)_(\d+)\.wav$"
_GOLD = "segment array<struct<start:string,end:string,speaker:string,speaker_label:string,text:string,split:string,tags:map<string,string>>>"


def recording_of(name: Column) -> Column:
    """Struct of station, channel, frequency_hz and start (UTC) from a recording's name; null where it doesn't fit or names no time."""
    part = lambda k: F.regexp_extract(name, RECORDING, k)
    start = F.try_to_timestamp(F.concat(part(4), part(5)), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    hz = F.rint(F.replace(part(3), F.lit("_"), F.lit(".")).try_cast("double") * 1_000_000).cast("long")
    return F.when(name.rlike(RECORDING) & start.isNotNull(), F.struct(part(1).alias("station"), part(2).alias("channel"), hz.alias("frequency_hz"), start.alias("start")))


def clip_path(recording: Column, number: Column, start_ms: Column, end_ms: Column) -> Column:
    """Where a segment's clip lies: its recording, its number with two digits at least, its bounds."""
    return F.format_string("%s/%02d_%d_%d.wav", recording, number, start_ms, end_ms)


def parsed_clip(path: Column) -> Column:
    """Struct of recording, number, start_ms and end_ms from a clip's path: the inverse of ``clip_path``; null where it doesn't fit."""
    recording, name = F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.substring_index(path, "/", -1)
    number = lambda k: F.regexp_extract(name, CLIP, k).try_cast("long")
    return F.when(name.rlike(CLIP) & recording_of(recording).isNotNull(), F.struct(recording.alias("recording"), number(1).alias("number"), number(2).alias("start_ms"), number(3).alias("end_ms")))


def pairs(found: DataFrame) -> DataFrame:
    """recording_id (the XML's name), wav and xml of every name that has both, whatever its case.

    found: path, name, as ``files.listing`` gives them. Of several wave files
    of one name the one of the greatest path counts; every XML file counts.
    """
    parts = found.select("path", F.regexp_extract("name", r"^(.+)\.[^.]*$", 1).alias("stem"), F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).alias("kind"))
    waves = parts.filter("kind = 'wav'").groupBy(F.lower("stem").alias("folded")).agg(F.max("path").alias("wav"))
    texts = parts.filter("kind = 'xml'").select(F.lower("stem").alias("folded"), F.col("stem").alias("recording_id"), F.col("path").alias("xml"))
    return texts.join(waves, "folded").select("recording_id", "wav", "xml")


@pandas_udf(T.LongType())
def _length_ms(content: pd.Series) -> pd.Series:
    def one(data: bytes) -> int | None:
        try:
            with wave.open(io.BytesIO(data)) as w:
                return round(w.getnframes() * 1000 / w.getframerate())
        except (wave.Error, EOFError, ZeroDivisionError):
            return None

    return pd.Series([one(bytes(x)) for x in content], dtype="Int64")


def gold_references(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Gold rows by clip path, and what was wrong: (recording_id, number, warning).

    A segment's number is its place in the file. Segments without readable
    times or with a bad range, those that begin after the audio ends, and all
    of a recording whose audio can't be read are left out with a warning; an
    end after the audio's is cut, with a warning too. A segment without a split
    gets its recording's, by a hash, so that a recording stays on one side.
    """
    both = pairs(listing(spark, root))
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    audio = content.option("pathGlobFilter", "*.[wW][aA][vV]").load(root).select(F.col("path").alias("wav"), _length_ms("content").alias("audio_ms"))
    texts = content.option("pathGlobFilter", "*.[xX][mM][lL]").load(root).select(F.col("path").alias("xml"), F.from_xml(F.decode("content", "utf-8"), _GOLD)["segment"].alias("segments"))
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), WHITE, " "))
    rows = both.join(texts, "xml").join(audio, "wav").select("recording_id", "audio_ms", F.posexplode("segments").alias("at", "s")).select("recording_id", "audio_ms", (F.col("at") + 1).alias("number"), "s.*")
    rows = rows.withColumns({"a": F.expr("try_cast(start as double)"), "b": F.expr("try_cast(end as double)")})
    rows = rows.withColumns({"start_ms": F.rint(F.col("a") * 1000).cast("long"), "xml_end_ms": F.rint(F.col("b") * 1000).cast("long")}).withColumn("end_ms", F.least("xml_end_ms", "audio_ms"))
    lost = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "invalid_start_or_end").when((F.col("a") < 0) | (F.col("b") <= F.col("a")), "invalid_time_range")
        .when(F.col("audio_ms").isNull(), "audio_unreadable").when(F.col("start_ms") >= F.col("audio_ms"), "segment_outside_audio")
    )
    rows = rows.withColumn("lost", lost)
    warning = F.coalesce("lost", F.when(F.col("end_ms") < F.col("xml_end_ms"), "segment_end_clamped"))
    tags = F.transform_values(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda _, v: F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), WHITE, " ")))
    split = F.nullif(clean("split"), F.lit(""))
    gold = rows.filter("lost is null").select(
        clip_path(F.col("recording_id"), F.col("number"), F.col("start_ms"), F.col("end_ms")).alias("relative_path"), "recording_id", "number", "start_ms", "end_ms", clean("speaker").alias("speaker"), clean("speaker_label").alias("speaker_label"),
        clean("text").alias("text_raw"), tags.alias("tags"), F.coalesce(split, parity_split(F.col("recording_id"))).alias("split"), F.when(split.isNotNull(), "xml").otherwise("derived_recording_hash").alias("split_source"),
        F.coalesce(F.try_element_at(tags, F.lit("non_english")) == "1", F.lit(False)).alias("non_english"),
    )
    return gold, rows.select("recording_id", "number", warning.alias("warning")).filter("warning is not null")


def with_gold(segments: DataFrame, gold: DataFrame) -> DataFrame:
    """Every segment with its gold reference (a struct ``gold``, null if it has none), by source and path."""
    rest = [c for c in gold.columns if c not in ("source_id", "relative_path")]
    return segments.join(gold.select("source_id", "relative_path", F.struct(*rest).alias("gold")), ["source_id", "relative_path"], "left")
