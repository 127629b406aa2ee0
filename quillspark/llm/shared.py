"""Helpers of the training-data operators: shared storage and shipping of this package to executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Folders of local sessions that name none, by application.
_local: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, through Spark's own file server."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    # Texts can be long: fewer to a batch keep a worker's memory low.
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _local.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        _local[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written = path
    return made


@contextmanager
def few_files(spark: SparkSession) -> Iterator[None]:
    """Inside, small results of a shuffle are written as files of the advisory size, not one for each core at least."""
    spread = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(spread)
    spark.conf.set(spread, "false")
    try:
        yield
    finally:
        spark.conf.set(spread, before)


def discard(*frames: DataFrame) -> None:
    """Delete what `materialize` wrote of frames that nothing reads any more; other frames are left alone."""
    for f in frames:
        if at := f.__dict__.pop("_written", None):
            place = f.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            place.getFileSystem(f.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: the name, with underscores put before it while it is taken."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
