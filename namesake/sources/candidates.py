"""Candidates by left edition, written so that a stopped run goes on where it was.

An edition counts as written once its marker stands; markers are files made in
one step by the file system. What lies in the folder of an edition without a
marker is removed before the edition is worked out again, and is never read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesake.session import file_system, remove

#: Editions that are worked out and written by one job.
AT_ONCE = 8
LEFT = "left_seq"


def _marker(path: str, seq: int) -> str:
    return f"{path}/written/{LEFT}={seq}"


def written_editions(spark: SparkSession, path: str) -> list[int]:
    """Left editions whose candidates are complete; as many as there are editions."""
    folder, fs = file_system(spark, f"{path}/written")
    if not fs.exists(folder):
        return []
    return sorted(int(f.getPath().getName().partition("=")[2]) for f in fs.listStatus(folder))


def write_candidates(spark: SparkSession, path: str, editions: Sequence[int], make: Callable[[list[int]], DataFrame], at_once: int = AT_ONCE) -> list[int]:
    """Writes ``make(some editions)`` until all of ``editions`` are written; returns those this call wrote.

    ``make`` gets positions of left editions and returns their candidates with
    the position as ``left_seq``. It is asked for a few editions at a time, so
    that little is lost if the run stops.
    """
    done = set(written_editions(spark, path))
    rest = [e for e in editions if e not in done]
    for i in range(0, len(rest), at_once):
        some = rest[i : i + at_once]
        for e in some:
            remove(spark, f"{path}/candidates/{LEFT}={e}")
        make(some).filter(F.col(LEFT).isin(some)).write.mode("append").partitionBy(LEFT).parquet(f"{path}/candidates")
        for e in some:
            marker, fs = file_system(spark, _marker(path, e))
            fs.mkdirs(marker.getParent())
            fs.createNewFile(marker)
    return rest


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of the editions that are complete, from their folders alone."""
    done = written_editions(spark, path)
    if not done:
        raise FileNotFoundError(f"no candidates are complete in {path}")
    return spark.read.parquet(f"{path}/candidates").filter(F.col(LEFT).isin(done))
