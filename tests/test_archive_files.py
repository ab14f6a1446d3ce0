"""Scans of directories and gold recordings, on files made here."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from squelch.sources import directories, recordings
from test_files import wave

KNOWN = "relative_path string, size long, mtime_ns long"


def put(root, path, data, at):
    f = root / path
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_bytes(data)
    os.utime(f, (at, at))


def aged(root, at):
    for folder, _, _ in os.walk(root):
        os.utime(folder, (at, at))


def scan(spark, root, states, known, mode, now):
    visits = directories.walk(spark, str(root), states, mode)
    found = directories.classified(visits, known, [".wav", ".MP3"], mode, 120, now).cache()
    read = directories.observed(str(root), found).cache()
    return visits, found, read, directories.directory_states(visits, found, read, 120, now), directories.counters(visits, found, read).first().asDict()


def test_scan_descends_by_state_and_reads_what_changed(spark, tmp_path):
    put(tmp_path, "a/x/1.wav", wave(1), 1000)
    put(tmp_path, "a/x/2.WAV", b"junk", 1000)
    put(tmp_path, "a/notes.txt", b"n", 1000)
    put(tmp_path, "b/3.mp3", b"abc", 1000)
    put(tmp_path, "b/.hidden/4.wav", wave(1), 1000)
    put(tmp_path, "5.wav", wave(2), 4950)  # still being written
    (tmp_path / "empty").mkdir()
    aged(tmp_path, 1500)
    none = spark.createDataFrame([], KNOWN)
    _, found, read, states, n = scan(spark, tmp_path, None, none, "incremental", 5000)
    assert {k: v for k, v in n.items() if v} == {"dirs_listed": 5, "files_ignored": 1, "files_unsettled": 1, "files_read": 3}
    got = {r.relative_path: r for r in read.collect()}
    assert set(got) == {"a/x/1.wav", "a/x/2.WAV", "b/3.mp3"} and got["b/3.mp3"].sha256 == hashlib.sha256(b"abc").hexdigest()
    assert (got["a/x/1.wav"].duration_ms, got["a/x/2.WAV"].audio_error) == (1000, "not a wave file")
    kept = {r.relative_dir: (r.settled, r.subdirs) for r in states.collect()}
    assert kept == {"": (False, ["a", "b", "empty"]), "a": (True, ["x"]), "a/x": (True, []), "b": (True, []), "empty": (True, [])}
    states = spark.createDataFrame(states.collect(), directories.STATES)
    known = spark.createDataFrame([(r.relative_path, r.size, r.mtime_ns) for r in found.filter("state = 'read'").collect()], KNOWN)
    # Nothing changed since, but for time: the root is listed for its waiting file, nothing known is read.
    _, _, read, states, n = scan(spark, tmp_path, states, known, "incremental", 9000)
    assert {k: v for k, v in n.items() if v} == {"dirs_listed": 1, "dirs_skipped": 4, "files_read": 1} and [r.relative_path for r in read.collect()] == ["5.wav"]
    states = spark.createDataFrame(states.collect(), directories.STATES)
    assert all(r.settled for r in states.collect())
    known = known.union(spark.createDataFrame([(r.relative_path, r.size, r.mtime_ns) for r in read.collect()], KNOWN))
    # An unchanged tree: no directory is listed, no file opened.
    for f in ("a/x/1.wav", "a/x/2.WAV", "b/3.mp3", "5.wav"):
        assert os.path.exists(tmp_path / f)
    _, found, read, _, n = scan(spark, tmp_path, states, known, "incremental", 9000)
    assert {k: v for k, v in n.items() if v} == {"dirs_skipped": 5} and found.count() == 0 and read.count() == 0
    # A new file far below unsettles its own directory alone.
    put(tmp_path, "a/x/6.wav", wave(1), 6000)
    os.utime(tmp_path / "a/x", (6000, 6000))
    _, _, read, states, n = scan(spark, tmp_path, states, known, "incremental", 9000)
    assert {k: v for k, v in n.items() if v} == {"dirs_listed": 1, "dirs_skipped": 4, "files_unchanged": 2, "files_read": 1} and [r.relative_path for r in read.collect()] == ["a/x/6.wav"]
    # Full lists all and reads what is new; verify reads all.
    assert scan(spark, tmp_path, states, known, "full", 9000)[4]["files_read"] == 1
    assert scan(spark, tmp_path, states, known, "verify", 9000)[4]["files_read"] == 5


def test_scan_of_odd_trees(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        directories.walk(spark, str(tmp_path / "gone"))
    with pytest.raises(ValueError):
        directories.walk(spark, str(tmp_path), mode="some")
    put(tmp_path, "d/1.wav", wave(1), 1000)
    aged(tmp_path, 1500)
    at = os.stat(tmp_path).st_mtime_ns
    states = spark.createDataFrame([("", at, True, ["d", "lost"]), ("d", 5, True, []), ("lost", 7, True, ["deep"])], directories.STATES)
    none = spark.createDataFrame([], KNOWN)
    visits, found, _, after, n = scan(spark, tmp_path, states, none, "incremental", 5000)
    assert {k: v for k, v in n.items() if v} == {"dirs_listed": 1, "dirs_skipped": 1, "dirs_vanished": 1, "files_read": 1}
    assert sorted(r.relative_dir for r in after.collect()) == ["", "d"]
    wrong = found.withColumn("size", F.col("size") + 1).union(found.withColumn("relative_path", F.lit("d/none.wav")))
    assert sorted(r.problem for r in directories.observed(str(tmp_path), wrong).collect()) == ["changing", "vanished"]
    assert [r.relative_dir for r in directories.walk(spark, str(tmp_path), scope="d").collect()] == ["d"]


NAME = "KXYZ_North_Tower_118_7MHz_20250102_030405"


def segment(start, end, text, more=""):
    return f"<segment><start>{start}</start><end>{end}</end><speaker> A  b </speaker><text>{text}</text>{more}</segment>"


def test_gold_references(spark, tmp_path):
    body = [segment(0, 0.5, "one  two"), segment("x", 1, "bad"), segment(0.75, 0.25, "bad"), segment(1.0005, 9, "long", "<split>test</split><tags><non_english>1</non_english><other> q  r </other></tags>"), segment(2, 3, "after")]
    put(tmp_path, f"deep/{NAME}.xml", ("<data>" + "".join(body) + "</data>").encode(), 1000)
    put(tmp_path, f"{NAME.lower()}.WAV", wave(1.5), 1000)
    put(tmp_path, "lonely.xml", b"<data/>", 1000)
    put(tmp_path, "broken.xml", ("<data>" + segment(0, 1, "x") + "</data>").encode(), 1000)
    put(tmp_path, "broken.wav", b"junk", 1000)
    gold, warned = recordings.gold_references(spark, str(tmp_path))
    rows = {r.number: r for r in gold.collect()}
    assert set(rows) == {1, 4}
    assert (rows[1].relative_path, rows[1].text_raw, rows[1].speaker, rows[1].split_source, rows[1].non_english) == (f"{NAME}/01_0_500.wav", "one two", "A b", "derived_recording_hash", False)
    assert (rows[4].start_ms, rows[4].end_ms, rows[4].split, rows[4].non_english, rows[4].tags["other"]) == (1000, 1500, "test", True, "q r")
    even = hashlib.sha256(NAME.lower().encode()).digest()[0] % 2 == 0
    assert rows[1].split == ("calibration" if even else "test")
    assert sorted((r.recording_id == NAME, r.number, r.warning) for r in warned.collect()) == [
        (False, 1, "audio_unreadable"), (True, 2, "invalid_start_or_end"), (True, 3, "invalid_time_range"), (True, 4, "segment_end_clamped"), (True, 5, "segment_outside_audio"),
    ]
    segments = spark.createDataFrame([(7, 1, f"{NAME}/01_0_500.wav"), (8, 2, f"{NAME}/01_0_500.wav"), (9, 1, "z.wav")], "segment_id long, source_id long, relative_path string")
    joined = recordings.with_gold(segments, gold.withColumn("source_id", F.lit(1).cast("long"))).collect()
    assert {r.segment_id: r.gold and r.gold.text_raw for r in joined} == {7: "one two", 8: None, 9: None}


def test_names(spark):
    names = [NAME, "KXYZ_A_118MHz_20250102_030405", "kxyz_A_118MHz_20250102_030405", "KXYZ_A_118MHz_20251302_030405", "KXYZ_118MHz_20250102_030405", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(recordings.recording_of(F.col("n")).alias("r"), recordings.parsed_clip(F.concat("n", F.lit("/103_5_60.wav"))).alias("c"), recordings.parsed_clip(F.concat("n", F.lit("/3_5_60.wav"))).alias("d")).collect()
    assert [r.r and (r.r.station, r.r.channel, r.r.frequency_hz, str(r.r.start)) for r in rows] == [("KXYZ", "North_Tower", 118_700_000, "2025-01-02 03:04:05"), ("KXYZ", "A", 118_000_000, "2025-01-02 03:04:05"), None, None, None, None]
    assert [r.c and (r.c.number, r.c.start_ms, r.c.end_ms) for r in rows] == [(103, 5, 60)] * 2 + [None] * 4 and all(r.d is None for r in rows)
