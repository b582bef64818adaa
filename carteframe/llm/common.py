"""What several operators share: tables, cut lineage, Arrow slices."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a vectorised kernel works on at once; a single longer text makes a slice of its own.
SLICE_BYTES = 1_000_000
#: Rows of an Arrow batch.
BATCH_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of an Arrow batch, about.
BATCH_BYTES = 4_000_000
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def integer_ids(df: DataFrame, id_col: str) -> None:
    """Refuses ids that aren't integers, which a cast to long would lose."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer, is {kind.simpleString()}")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, removed when the driver ends; only where none
    is set and the master is local (tests), a new local one."""
    app = spark.sparkContext.applicationId
    if app in _RUNS:
        return _RUNS[app]
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="carteframe-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    run = _RUNS[app] = f"{path.rstrip('/')}/carteframe-{app}"
    atexit.register(_remove, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), run)
    return run


_RUNS: dict[str, str] = {}


def _remove(jvm, conf, path: str) -> None:
    """Deletes a run's tables when the driver ends; a store that can't be reached any more keeps them."""
    try:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    except Exception:  # noqa: BLE001  the gateway may be gone
        pass


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: df as a written table in the shared folder.

    Unlike checkpoint(), the reread table has no partitioning, so a later join puts an exchange on both sides and
    adaptive execution can split its hot keys.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the write's shuffle files go when it ends, not when the driver collects its garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread_sample(df: DataFrame, hash_col: str, rows: int) -> DataFrame:
    """At most rows rows of df, one for each hash: of each of rows buckets of hash_col (long) the least hash.

    The choice is one aggregate with partial aggregation, and only as many hashes as there are buckets are sent out, so
    nothing grows with the input, and rows of one hash, however many, count once."""
    picked = df.groupBy(F.pmod(F.col(hash_col), F.lit(rows)).alias("_bucket")).agg(F.min(hash_col).alias(hash_col)).select(hash_col)
    return df.join(F.broadcast(picked), hash_col, "left_semi").dropDuplicates([hash_col])


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow with batches of BATCH_ROWS rows and some BATCH_BYTES: whole texts can be long, and the session's
    defaults (10,000 rows, 64 MB) cost an executor several times that. The settings stay in the session, as Spark reads
    them when the frame is run, which is after this returns; smaller ones of the session's own stay."""
    small_batches(df.sparkSession)
    return df.mapInArrow(_lean(run), schema)


def small_batches(spark: SparkSession) -> None:
    for name, most in ((ARROW_ROWS, BATCH_ROWS), (ARROW_BYTES, BATCH_BYTES)):
        held = spark.conf.get(name, None) or "0"
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(name, str(most))


def _lean(run: Callable) -> Callable:
    """run, giving freed memory back to the system when a task ends: idle workers stay, and executors count them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the strings in column come to about limit bytes each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(batch.schema.get_field_index(column))
        lengths = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)
