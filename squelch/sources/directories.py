"""Scans of an archive on a mount that all executors see: only changed directories are listed, only changed files read.

Directories are visited level by level. A level is a table; tasks look at its
directories, so a listing is spread over the cluster, and the subdirectories
they name are the next level. A directory that was settled and hasn't changed
since isn't listed: what the last scan knew of its subdirectories leads on.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squelch.functions.text import parent_dir
from squelch.session import stored
from squelch.sources.files import _wav_head

#: Entries in a row of a listing: a directory of millions of files is many rows.
ENTRIES = 10_000
STATES = "relative_dir string, mtime_ns long, settled boolean, subdirs array<string>"
_ROWS = "relative_dir string, mtime_ns long, visit string, subdirs array<string>, files array<struct<name:string,size:long,mtime_ns:long>>"
_READ = "relative_path string, size long, mtime_ns long, problem string, sha256 string, duration_ms long, rate int, channels int, audio_error string"
MODES = ("full", "incremental", "verify")


def _entries(root: str, relative: str) -> Iterator[tuple[list[str], list[tuple[str, int, int]]]]:
    """A directory's subdirectories and files, some thousands at a time; links and hidden entries are left out."""
    dirs, found = [], []
    with os.scandir(os.path.join(root, relative)) as entries:
        for e in entries:
            if e.name.startswith(".") or e.is_symlink():
                continue
            if e.is_dir():
                dirs.append(e.name)
            elif e.is_file():
                s = e.stat()
                found.append((e.name, s.st_size, s.st_mtime_ns))
            if len(dirs) + len(found) >= ENTRIES:
                yield dirs, found
                dirs, found = [], []
    yield dirs, found


def _visits(root: str, mode: str):
    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["relative_dir", "mtime_ns", "visit", "subdirs", "files"]
        for batch in batches:
            for d, known, settled, subdirs in zip(batch["relative_dir"], batch["known_ns"], batch["settled"], batch["known_subdirs"], strict=True):
                try:
                    at = os.stat(os.path.join(root, d)).st_mtime_ns
                    if mode == "incremental" and settled is True and str(at) == known:
                        yield pd.DataFrame([(d, at, "skipped", list(subdirs) if subdirs is not None else [], [])], columns=columns)
                        continue
                    for dirs, found in _entries(root, d):
                        yield pd.DataFrame([(d, at, "listed", dirs, found)], columns=columns)
                except FileNotFoundError:
                    yield pd.DataFrame([(d, None, "vanished", [], [])], columns=columns)

    return visit


def walk(spark: SparkSession, root: str, states: DataFrame | None = None, mode: str = "full", scope: str = "") -> DataFrame:
    """Rows of a visit: relative_dir, mtime_ns, visit (listed, skipped or vanished), subdirs and files of each directory under ``scope``.

    ``states`` (relative_dir, mtime_ns, settled, subdirs) come from an earlier
    scan's ``directory_states`` and count in mode ``incremental`` alone. The
    root itself is ''. A missing root or scope is an error, so that an archive
    that isn't mounted can't pass for an empty one. One job for each level of
    the tree; the driver sees only whether there is a next one.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if not os.path.isdir(os.path.join(root, scope)):
        raise FileNotFoundError(f"no directory {scope!r} under {root}")
    known = (states if states is not None else spark.createDataFrame([], STATES)).selectExpr("relative_dir as _d", "cast(mtime_ns as string) as known_ns", "settled", "subdirs as known_subdirs")
    level, found = spark.createDataFrame([(scope,)], "relative_dir string"), None
    while True:
        visits = level.join(known, F.col("relative_dir") == F.col("_d"), "left").select("relative_dir", "known_ns", "settled", "known_subdirs").repartition("relative_dir")
        rows = stored(visits.mapInPandas(_visits(root, mode), _ROWS), "directories")
        found = rows if found is None else found.unionByName(rows)
        below = rows.select("relative_dir", F.explode("subdirs").alias("s"))
        if below.isEmpty():
            return found
        level = below.select(F.when(F.col("relative_dir") == "", F.col("s")).otherwise(F.concat("relative_dir", F.lit("/"), "s")).alias("relative_dir"))


def classified(visits: DataFrame, known: DataFrame, extensions: Sequence[str], mode: str = "incremental", settle_s: int = 120, now: float | None = None) -> DataFrame:
    """Every file of the listed directories with ``state``: ignored (another extension), unsettled, unchanged or read.

    known: relative_path, size, mtime_ns of the files that the archive has.
    Files that changed less than ``settle_s`` ago may still be written: they
    wait. Unchanged ones aren't read, but for mode ``verify``.
    """
    now_ns = int((time.time() if now is None else now) * 1e9)
    rows = visits.filter("visit = 'listed'").select("relative_dir", F.explode("files").alias("f")).select("relative_dir", "f.*")
    rows = rows.withColumn("relative_path", F.when(F.col("relative_dir") == "", F.col("name")).otherwise(F.concat("relative_dir", F.lit("/"), "name")))
    old = known.select(F.col("relative_path").alias("_p"), F.col("size").alias("_s"), F.col("mtime_ns").alias("_m"))
    wanted = F.lower(F.regexp_extract("name", r"[^.](\.[^.]*)$", 1)).isin([e.lower() for e in extensions])
    same = F.lit(mode != "verify") & (F.col("size") == F.col("_s")) & (F.col("mtime_ns") == F.col("_m"))
    state = F.when(~wanted, "ignored").when(F.lit(now_ns) - F.col("mtime_ns") < int(settle_s * 1e9), "unsettled").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("read")
    return rows.join(old, F.col("relative_path") == F.col("_p"), "left").select("relative_dir", "relative_path", "size", "mtime_ns", F.col("_p").isNotNull().alias("known"), state.alias("state"))


def observed(root: str, files: DataFrame) -> DataFrame:
    """What the files in state ``read`` hold: hash and audio head, or the problem (vanished, changing, error).

    A file whose length isn't what its listing said is still changing.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, at in zip(batch["relative_path"], batch["size"], batch["mtime_ns"], strict=True):
                row, problem = (None, None, None, None, None), None
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        data = f.read()
                    if len(data) != size:
                        problem = "changing"
                    else:
                        row = (hashlib.sha256(data).hexdigest(), *_wav_head(data))
                except FileNotFoundError:
                    problem = "vanished"
                except OSError:
                    problem = "error"
                yield pd.DataFrame([(path, size, at, problem, *row)], columns=[c.split()[0] for c in _READ.split(", ")]).astype(object)

    return files.filter("state = 'read'").select("relative_path", "size", "mtime_ns").repartition("relative_path").mapInPandas(read, _READ)


def directory_states(visits: DataFrame, files: DataFrame, observations: DataFrame, settle_s: int = 120, now: float | None = None) -> DataFrame:
    """What the next scan has to know: relative_dir, mtime_ns, settled, subdirs of every directory that is there.

    A directory is settled once neither it nor any of its files can still be
    changing; a file that vanished meanwhile doesn't unsettle it.
    """
    now_ns = int((time.time() if now is None else now) * 1e9)
    dirs = visits.filter("visit <> 'vanished'").groupBy("relative_dir").agg(F.max("mtime_ns").alias("mtime_ns"), F.max("visit").alias("visit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("subdirs")))).alias("subdirs"))
    waiting = files.filter("state = 'unsettled'").select("relative_dir").union(observations.filter("problem in ('changing', 'error')").select(parent_dir(F.col("relative_path"))))
    waiting = waiting.toDF("relative_dir").distinct().withColumn("waits", F.lit(True))
    old = F.lit(now_ns) - F.col("mtime_ns") >= int(settle_s * 1e9)
    settled = (F.col("visit") == "skipped") | (old & F.col("waits").isNull())
    return dirs.join(waiting, "relative_dir", "left").select("relative_dir", "mtime_ns", settled.alias("settled"), "subdirs")


def counters(visits: DataFrame, files: DataFrame, observations: DataFrame) -> DataFrame:
    """One row: directories listed, skipped and vanished; files by state; files read and the problems met."""
    of = lambda column, value, name: F.count_if(F.col(column) == value).alias(name)
    dirs = visits.select("relative_dir", "visit").distinct().agg(*[of("visit", v, f"dirs_{v}") for v in ("listed", "skipped", "vanished")])
    by_state = files.agg(*[of("state", s, f"files_{s}") for s in ("ignored", "unsettled", "unchanged")])
    met = observations.agg(F.count_if(F.col("problem").isNull()).alias("files_read"), *[of("problem", p, f"files_{p}") for p in ("vanished", "changing", "error")])
    return dirs.crossJoin(by_state).crossJoin(met.withColumnRenamed("files_vanished", "files_gone"))  # one row each
