"""What the operators of this package share: reading, hosts, unique keys, cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

#: A side of a join is broadcast only if it was measured and has at most so many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

WORD = re.compile(r"[^\W_]+")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def host_of(url: Column) -> Column:
    """Host in lower case without user, port, leading ``www.`` and final dot; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(F.length(host) > 0, host)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A temporary one serves only local sessions that name none (tests); on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = f"file://{tempfile.mkdtemp(prefix='textharbor-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: short lineage that survives lost executors. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def _width(f: StructField) -> Column:
    """Bytes that a value takes in memory, roughly."""
    c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
    if kind in ("string", "binary"):
        return 16 + F.coalesce(F.octet_length(c), F.lit(0))
    if kind == "array":
        texts = F.octet_length(F.array_join(c, "")) if f.dataType.elementType.typeName() == "string" else F.lit(0)
        return 16 + F.coalesce(16 * F.size(c) + texts, F.lit(0))
    return F.lit(16)


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a frame. Give it one that was cut: it is read as a whole, by all executors."""
    size = sum((_width(f) for f in df.schema.fields), F.lit(0))
    r = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes")).first()
    return r.rows, r.bytes


def sized(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` for a join: broadcast if it has at most ``most`` rows and ``most_bytes`` bytes, else to be merged, whatever the planner guesses of its size."""
    rows, size = measured(df)
    return F.broadcast(df) if rows <= most and size <= most_bytes else df.hint("merge")


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row of each ``key`` (null counts as a key): where ``df`` is read straight from files, the first one in the order of files and positions.

    There, only key and row position are shuffled: the surplus rows are found by their position and taken out of the scan.
    Elsewhere rows have no position, and any one row of each key is kept.
    """
    try:
        at = df.select(F.col(key).alias("k"), F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).alias("at"))
    except AnalysisException:  # no file source below
        return df.dropDuplicates([key])
    extra = cut(at.groupBy("k").agg(F.min("at").alias("kept"), F.count("*").alias("n")).where("n > 1"))
    if not extra.limit(1).count():
        return df
    names = df.columns
    return (
        df.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__r"))
        .join(sized(extra.select(F.col("k").alias("__k"), "kept")), F.col(key).eqNullSafe(F.col("__k")), "left")
        .where("kept IS NULL OR (kept.f = __f AND kept.r = __r)")
        .select(*[F.col(f"`{n}`") for n in names])
    )


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function that yields dicts of column name to values."""
    from pyspark.sql.types import _parse_datatype_string

    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in _parse_datatype_string(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(batches):
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: arrays made of them stay within the processor's caches."""
    for b in batches:
        for low in range(0, b.num_rows, rows):
            yield b.slice(low, rows)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class Hashes(dict):
    """Stable 64-bit hashes of words, kept from batch to batch; emptied when it holds a million."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def hash_words(words: list[str], seen: Hashes) -> np.ndarray:
    if len(seen) > 1_000_000:
        seen.clear()
    return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))
