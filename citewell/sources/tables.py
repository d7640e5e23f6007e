"""Reading tables and writing snapshots, partitions and append-only sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GLOBAL_TENANT = "_global"
CLEANED_FILE = "cleaned.txt"
_CUTS: list[str] = []
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What is sent to Python at once. Texts take several times as much there as strings and results of their own.
PYTHON_BATCH_BYTES = 4 * 2**20


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python are bounded by bytes (Spark: 64 MB or 10,000 rows), so that a worker's memory does not grow with texts.
    A smaller bound of the session stays."""
    held = spark._jsparkSession.sessionState().conf().getConfString(BATCH_BYTES, "64m")
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(held) <= PYTHON_BATCH_BYTES:
        spark.conf.set(BATCH_BYTES, str(PYTHON_BATCH_BYTES))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A parquet table. Zone-less timestamps become instants of the session's time zone."""
    bounded_batches(spark)
    df = spark.read.parquet(f"{root}/{name}.parquet")
    for field in df.schema:
        if isinstance(field.dataType, T.TimestampNTZType):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder all executors can reach, under spark.checkpoint.dir. Only a session of one machine may leave
    that unset; it then uses a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="citewell-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """The same rows as a written table: later steps that read them several times do not compute them
    again, and a lost executor costs no more than the steps since."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    _CUTS.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_cuts(spark: SparkSession) -> int:
    """Delete the tables ``cut`` has written so far; for the end of a job, when its results are stored."""
    released = 0
    while _CUTS:
        delete(spark, _CUTS.pop())
        released += 1
    return released


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def object_key(tenant_id: Column, document_id: Column, version: Column) -> Column:
    """Key of a cleaned text: tenant (or _global), document, version and file name. NULL when invalid."""
    valid = (F.length(document_id) > 0) & (version >= 1)
    parts = [F.coalesce(tenant_id, F.lit(GLOBAL_TENANT)), document_id, version.cast("string"), F.lit(CLEANED_FILE)]
    return F.when(valid, F.concat_ws("/", *parts))


def parse_object_key(key: Column) -> Column:
    """Struct of tenant, document and version; NULL for a key of another shape."""
    parts = F.split(key, "/")
    version = F.try_element_at(parts, F.lit(3)).try_cast("int")
    valid = (
        (F.size(parts) == 4)
        & (F.try_element_at(parts, F.lit(4)) == CLEANED_FILE)
        & (F.try_element_at(parts, F.lit(2)) != "")
        & (version >= 1)
    )
    tenant = F.nullif(F.try_element_at(parts, F.lit(1)), F.lit(GLOBAL_TENANT))
    return F.when(
        valid,
        F.struct(tenant.alias("tenant_id"), F.try_element_at(parts, F.lit(2)).alias("document_id"), version.alias("version")),
    )


def write_cleaned_texts(docs: DataFrame, path: str) -> None:
    """Cleaned texts as one partition per tenant, so that deleting a tenant drops a directory.

    The rebalance hint sizes the files: a tenant with many documents gets many, small ones are merged.
    """
    keyed = docs.select(
        F.coalesce("tenant_id", F.lit(GLOBAL_TENANT)).alias("tenant_id"), "document_id", "version", "cleaned_text"
    )
    keyed.hint("rebalance", "tenant_id").write.mode("append").partitionBy("tenant_id").parquet(path)


def read_cleaned_texts(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.option("recursiveFileLookup", "false").parquet(path)
    return stored.withColumn("tenant_id", F.nullif(F.col("tenant_id").cast("string"), F.lit(GLOBAL_TENANT)))


def drop_tenant(spark: SparkSession, path: str, tenant_id: str) -> None:
    """Delete one tenant's partition directory; the others stay as they are."""
    delete(spark, f"{path}/tenant_id={tenant_id}")


def write_postings(posting_rows: DataFrame, path: str) -> None:
    """Postings sorted by term inside the files, so that a term's filter skips row groups."""
    posting_rows.hint("rebalance", "term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def write_snapshot(df: DataFrame, root: str, number: int) -> str:
    """A numbered full copy. Rewriting a number replaces it, so a repeated batch does no harm."""
    path = f"{root}/snapshot={number:012d}"
    df.write.mode("overwrite").parquet(path)
    return path


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def visible_documents(spark: SparkSession, path: str) -> DataFrame:
    """Stored document versions that may be searched."""
    return spark.read.parquet(path).where("visible")
