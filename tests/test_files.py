import json
import struct
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from squelch.sources import files


def wave(seconds: float, rate: int = 8000) -> bytes:
    data = b"\0\0" * int(seconds * rate)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def test_listing_and_probe(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.wav").write_bytes(wave(1.5))
    (tmp_path / "d/b.wav").write_bytes(b"junk")
    found = files.listing(spark, str(tmp_path), "*.wav")
    assert sorted(r.name for r in found.collect()) == ["a.wav", "b.wav"]
    with pytest.raises(FileNotFoundError):
        files.listing(spark, str(tmp_path), "*.mp3")
    later = F.lit("2100-01-01").cast("timestamp")
    assert files.changed_files(found, found.limit(0), "incremental", later).count() == 2
    assert files.changed_files(found, found, "incremental", later).count() == 0
    assert files.changed_files(found, found, "full", F.lit("2000-01-01").cast("timestamp")).count() == 0
    probed = spark.read.format("binaryFile").load(f"{tmp_path}/d").select(files.probe_wave(F.col("content")).alias("p")).collect()
    assert sorted((r.p.duration_ms or 0, r.p.error) for r in probed) == [(0, "not a wave file"), (1500, None)]


def test_xml_csv_json(spark, tmp_path):
    (tmp_path / "g.xml").write_text("<data><segment><start>0.5</start><end>2</end><speaker>A</speaker><text>hello [#x]</text></segment><segment><start>x</start><end>2</end></segment><segment><start>3</start><end>2</end></segment></data>")
    rows = files.gold_xml(spark, str(tmp_path / "g.xml")).collect()
    assert [r.problem for r in rows] == [None, "invalid number", "invalid range"] and rows[0].text == "hello [#x]"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("F.csv", "A,B\n1,é\n".encode("latin-1"))
    assert [r.row for r in files.zipped_csv(spark, str(tmp_path / "z.zip"), "F.csv").collect()] == [{"A": "1", "B": "é"}]
    (tmp_path / "m.json").write_text(json.dumps({"features": [{"properties": {"n": "x"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    assert [r.properties for r in files.geojson(spark, str(tmp_path / "m.json"), ["Point"]).collect()] == [{"n": "x"}]
    (tmp_path / "a.zst").write_bytes(zstandard.compress(b'{"text": "hi"}'))
    assert files.artifacts(spark, str(tmp_path / "a.zst"), "text string").first().body.text == "hi"


def test_words_and_catalogue(spark):
    body = json.dumps({"segments": [{"words": [{"word": "hi", "start": 0.1, "end": 0.25}]}]})
    rows = spark.createDataFrame([(body,), ('{"segments": [{"words": [{"word": "x"}]}]}',)], "b string").select(files.words_of_response(F.col("b")).alias("w")).collect()
    assert [tuple(x) for x in rows[0].w] == [(100, 250, "hi")] and rows[1].w is None
    found = files.catalogue(spark, '[families.canary]\nvendor = "n"\n[models.canary-a]\nfamily = "canary"\nensemble_eligible = true\n')
    assert found["models"].first().family == "canary" and found["families"].count() == 1
