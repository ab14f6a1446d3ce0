"""Files of an archive: listings, recordings, gold XML, zipped CSV, GeoJSON, artifacts, catalogues."""

from __future__ import annotations

import io
import json
import struct
import tomllib
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from squelch.functions.text import base_name, parent_dir


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files under a root: path, relative_dir, name, modified, size. Contents aren't read; hidden files are left out.

    An empty or missing root is an error, so that it can't pass for an archive
    whose files are all gone.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rows = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    if rows.isEmpty():
        raise FileNotFoundError(f"nothing under {root}")
    return rows.withColumns({"relative_dir": parent_dir(F.col("path")), "name": base_name(F.col("path"))}).filter(~F.col("name").startswith("."))


def changed_files(found: DataFrame, known: DataFrame, mode: str, now: Column, settle_s: int = 120) -> DataFrame:
    """Files to look at: all (``full``, ``verify``) or new and changed ones (``incremental``); files still being written wait."""
    ready = found.filter(F.col("modified") <= now - F.make_interval(secs=F.lit(settle_s)))
    if mode != "incremental":
        return ready
    old = known.select(F.col("path").alias("k"), F.col("modified").alias("m"), F.col("size").alias("s"))
    same = (F.col("path") == F.col("k")) & (F.col("modified") == F.col("m")) & (F.col("size") == F.col("s"))
    return ready.join(old, same, "left_anti")


_WAV = T.StructType().add("duration_ms", T.LongType()).add("rate", T.IntegerType()).add("channels", T.IntegerType()).add("error", T.StringType())


def _wav_head(data: bytes) -> tuple[int | None, int | None, int | None, str | None]:
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None, None, None, "not a wave file"
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data" and form and form[3]:
            return min(size, len(data) - at - 8) * 1000 // form[3], form[2], form[1], None
        at += 8 + size + size % 2
    return None, None, None, "no audio data"


@pandas_udf(_WAV)
def _probe(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_wav_head(bytes(x)) for x in data], columns=["duration_ms", "rate", "channels", "error"])


def probe_wave(content: Column) -> Column:
    """Duration, rate and channels of a wave file, or the error; never fails."""
    return _probe(content)


def gold_xml(spark: SparkSession, path: str) -> DataFrame:
    """Segments of gold XML files (start, end, speaker, text), those with a bad range or number in ``problem``."""
    schema = "start string, end string, speaker string, speaker_label string, text string"
    rows = spark.read.format("xml").option("rowTag", "segment").schema(schema).load(path)
    times = rows.withColumns({"start_s": F.expr("try_cast(start as double)"), "end_s": F.expr("try_cast(end as double)")})
    problem = F.when(F.col("start_s").isNull() | F.col("end_s").isNull(), "invalid number").when(F.col("end_s") <= F.col("start_s"), "invalid range")
    return times.select("start_s", "end_s", "speaker", "speaker_label", "text", problem.alias("problem"))


def zipped_csv(spark: SparkSession, path: str, member: str) -> DataFrame:
    """Rows of a CSV member (Latin-1, with a header) of ZIP files, as maps from column to value; one archive is one task's work."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    for part in pd.read_csv(f, dtype=str, encoding="latin-1", keep_default_na=False, chunksize=10_000):
                        yield pd.DataFrame({"path": path, "row": part.to_dict("records")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, row map<string,string>")


def geojson(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    """Features of GeoJSON files: properties and the geometry as JSON text."""
    feature = "properties map<string,string>, geometry struct<type:string,coordinates:string>"
    rows = spark.read.schema(f"features array<struct<{feature.replace(' map', ':map').replace(' struct', ':struct').replace(', geometry', ',geometry')}>>").json(path, multiLine=True)
    found = rows.select(F.explode("features").alias("f")).select("f.properties", "f.geometry")
    return found if kinds is None else found.filter(F.col("geometry.type").isin(kinds))


@pandas_udf(T.StringType())
def _unzstd(data: pd.Series) -> pd.Series:
    import zstandard

    return pd.Series([zstandard.ZstdDecompressor().decompressobj().decompress(bytes(x)).decode() for x in data])


def artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Zstandard-compressed JSON files, parsed."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.from_json(_unzstd("content"), schema).alias("body"))


def write_lines(frame: DataFrame, path: str) -> None:
    """One JSON line for each row, keys in order, Zstandard-compressed."""
    frame.select(F.to_json(F.struct(*sorted(frame.columns))).alias("value")).write.option("compression", "zstd").text(path)


def catalogue(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """Families and models of a TOML catalogue (a small file, read by the driver)."""
    data = tomllib.loads(text)
    families = [(name, json.dumps(x, sort_keys=True)) for name, x in data.get("families", {}).items()]
    models = [(name, x.get("family"), bool(x.get("ensemble_eligible", False)), json.dumps(x, sort_keys=True)) for name, x in data.get("models", {}).items()]
    return {
        "families": spark.createDataFrame(families, "family string, settings string"),
        "models": spark.createDataFrame(models, "model string, family string, ensemble_eligible boolean, settings string"),
    }


WORD = "struct<word:string,start:double,end:double,probability:double>"


def words_of_response(body: Column) -> Column:
    """Timed words (start_ms, end_ms, word) of a verbose response as JSON; null if a word has no time."""
    parsed = F.from_json(body, f"segments array<struct<words:array<{WORD}>>>")
    words = F.flatten(F.transform(F.coalesce(parsed["segments"], F.array().cast(f"array<struct<words:array<{WORD}>>>")), lambda s: F.coalesce(s["words"], F.array().cast(f"array<{WORD}>"))))
    timed = F.forall(words, lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    return F.when(timed, F.transform(words, lambda w: F.struct(F.round(w["start"] * 1000).cast("int").alias("start_ms"), F.round(w["end"] * 1000).cast("int").alias("end_ms"), w["word"].alias("word"))))
