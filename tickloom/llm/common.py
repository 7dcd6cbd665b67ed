"""Plumbing of the corpus operators: column passing, fresh names, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column of df has it (case-insensitively)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for cut lineage; a default only where it is unset (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        known = sc._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints"
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost executor costs only a reread.

    Unlike checkpoint() the files are columnar and compressed, and later stages read only the columns they name.
    The folder is removed when the driver's session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _forget_later(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget_later(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)


def discard(df: DataFrame) -> None:
    """Remove the files of a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/tickloom-"
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = path.find("tickloom-")
        if at >= 0 and root.rsplit("/", 1)[1] == path[at : at + 9]:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of an Arrow batch handed to Python at a time (or one row), whatever the length of the texts.
ARROW_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded by bytes; a smaller setting stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(name)).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))
    return df


Batch = Callable[[pa.Array], list[pa.Array]]


def map_texts(df: DataFrame, key: str, text: str, fields: list[T.StructField], make: Callable[[], Batch]) -> DataFrame:
    """Per row: the key, and what ``make()(texts)`` returns for it.

    Reads the two named columns only, whatever else df has.  ``make`` runs once
    for each task, so models load once.
    """
    source = df.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).cast("string").alias("t"))
    schema = T.StructType([T.StructField(key, source.schema["k"].dataType), *fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *f(b.column(1))], names)

    return bounded(source).mapInArrow(run, schema)


def add_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Batch]) -> DataFrame:
    """df with further columns computed from its text column; ``fields`` must have fresh names."""
    index = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, *fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *f(b.column(index))], names)

    return bounded(df).mapInArrow(run, schema)
