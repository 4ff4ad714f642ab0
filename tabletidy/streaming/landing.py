"""ST1: clean every CSV that arrives in a landing directory, each exactly once.

Files differ in their headers, so the stream carries file *paths*, not rows: a
``binaryFile`` stream (``content`` is never read, the column is pruned) lists new
``*.csv`` names, and each micro-batch runs the batch ingest job per file, several at a
time. ``foreachBatch`` may replay a batch, so a run's id is derived from the file's path,
size and modification time, artifacts are overwritten, and files whose id is recorded are
passed over. The batch appends its runs to the history once; a file that fails is recorded
in the ``failures`` table. ``availableNow`` processes what is there and stops;
``processingTime`` keeps watching.
"""

from __future__ import annotations

import functools
import hashlib
import logging
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabletidy.plans.pipeline import ingest
from tabletidy.session import checkpoint_dir
from tabletidy.sources.files import CSV_GLOB, is_csv_name
from tabletidy.sources.tables import append_failures, append_runs, recorded

log = logging.getLogger("tabletidy")

BINARY_FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("modificationTime", T.TimestampType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("content", T.BinaryType(), True),
    ]
)


def arriving_files(spark: SparkSession, landing: str, max_files_per_trigger: int = 16) -> DataFrame:
    """A stream of new CSV paths (with times and sizes) below ``landing``, oldest first."""
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("pathGlobFilter", CSV_GLOB)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .option("recursiveFileLookup", True)
        .load(landing)
        .select("path", "modificationTime", "length")
    )


def upload_id(path: str, modified: object, length: int) -> str:
    """The SHA-256 that names one state of one file (a shorter one would be shared by two uploads)."""
    return hashlib.sha256(f"{path}|{modified}|{length}".encode()).hexdigest()


def empty_uploads(spark: SparkSession, landing: str) -> list[dict]:
    """CSV files of no bytes below ``landing``: the scan leaves them out, so they are listed here."""
    path = spark._jvm.org.apache.hadoop.fs.Path(landing)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while listed.hasNext():
        one = listed.next()
        if one.getLen() == 0 and is_csv_name(one.getPath().getName()):
            found.append({"path": one.getPath().toString(), "modificationTime": one.getModificationTime(), "length": 0})
    return found


#: Attempts at a file whose job failed (a lost executor, a store that is away), and the seconds before the second.
ATTEMPTS = 3
BACKOFF = 2.0


def file_fault(exc: Exception) -> bool:
    """Whether the file itself is at fault (empty, malformed, gone): another attempt would end alike."""
    text = str(exc)
    return isinstance(exc, ValueError) or any(t in text for t in ("CSV record with more cells", "PATH_NOT_FOUND", "FileNotFoundException"))


def ingest_batch(spark: SparkSession, files: list, root: str, user_email: str | None = None, at_a_time: int = 4) -> None:
    """Clean the files (path, modificationTime, length) that are not recorded, and record them.

    A file that is at fault itself becomes a row of ``failures``. A job that fails otherwise is tried
    again after a pause; if it fails to the end, the other files of the batch are recorded and
    the fault is raised, so the stream stops and takes the batch again when it is started next.
    """
    root = root.rstrip("/")
    named = {upload_id(f["path"], f["modificationTime"], f["length"]): f["path"] for f in files}
    done = recorded(spark, root, list(named)) if named else set()
    todo = sorted((path, rid) for rid, path in named.items() if rid not in done)

    def one(job: tuple[str, str]):
        path, rid = job
        for attempt in range(ATTEMPTS):
            try:
                return ingest(spark, path, root, user_email, run_id=rid, record=False)
            except Exception as exc:  # noqa: BLE001 - one bad file must not stop the stream; it is recorded below
                log.warning("ingest of %s failed: %s", path, exc)
                if file_fault(exc):
                    return rid, path, f"{type(exc).__name__}: {exc}"
                last = exc
            time.sleep(BACKOFF * 2**attempt)
        return last

    with ThreadPoolExecutor(at_a_time) as pool:
        results = list(pool.map(one, todo))
    if failed := [r for r in results if isinstance(r, tuple)]:
        append_failures(spark, failed, root)
    faults = [r for r in results if isinstance(r, Exception)]
    if good := [r for r in results if not isinstance(r, (tuple, Exception))]:
        append_runs(functools.reduce(DataFrame.unionByName, [r.runs for r in good]), functools.reduce(DataFrame.unionByName, [r.profiles for r in good]), root)
    if faults:  # the batch is not done: it is tried again when the stream starts next
        raise faults[0]


def watch_landing(
    spark: SparkSession,
    landing: str,
    root: str,
    user_email: str | None = None,
    checkpoint: str | None = None,
    available_now: bool = True,
    interval: str = "30 seconds",
    max_files_per_trigger: int = 16,
) -> StreamingQuery:
    """Start the landing-directory job; its runs and failures are in the tables under ``root``.

    The micro-batch holds at most ``max_files_per_trigger`` paths, so listing them on
    the driver is bounded; the cleaning of each file is a distributed job.
    """
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/tabletidy-landing"

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        ingest_batch(spark, [*batch.collect(), *empty_uploads(spark, landing)], root, user_email)

    writer = arriving_files(spark, landing, max_files_per_trigger).writeStream.foreachBatch(per_batch).option(
        "checkpointLocation", ckpt
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
