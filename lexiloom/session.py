"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: The column that ``cluster_blocks`` adds.
BLOCK = "_text_block"


def build_session(name: str = "lexiloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Hash join instead of sort-merge where every partition is known to fit.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**base, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else one below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stored"


def materialize(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Write a table that several later stages read, and read it back.

    Used where recomputing would repeat the expensive tokenising; the written
    table also survives the loss of executors. ``schema`` reads the columns as
    other types of the same stored shape. ``drop_stored`` removes the table once
    nothing reads it any more; what is not dropped stays for the folder's owner.
    A table of blocks (``cluster_blocks``) is stored in buckets, so that it is read clustered by block.
    """
    spark = df.sparkSession
    key = uuid.uuid4().hex
    path = f"{shared_folder(spark)}/tables/{name}-{key}"
    if BLOCK in df.columns:
        rows = df.write.format("parquet").option("compression", "zstd").bucketBy(block_parts(df), BLOCK)
        rows.option("path", path).saveAsTable(f"blocks_{key}")
        out = spark.table(f"blocks_{key}")
    else:
        # how many parts texts are dealt in goes by their stored size: it stays comparable
        df.write.option("compression", "snappy" if "text" in df.columns else "zstd").parquet(path)
        out = spark.read.schema(schema or df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(table: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` returned. Frames that still read it fail afterwards."""
    spark = table.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of stored input for one partition of clustered texts: their terms take up to a hundred times that in memory.
CLUSTER_BYTES = 4 << 20


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files a table is read from; 0 if there are none."""
    spark = df.sparkSession
    total = 0
    for file in df.inputFiles():
        target = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
        total += target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).getLen()
    return total


def cluster_parts(df: DataFrame) -> int:
    """Partitions that ``cluster`` makes of a table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored_bytes(df) // CLUSTER_BYTES))


def cluster(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Hash the rows by key once; later steps on the same keys need no shuffle.

    The number of partitions is ``spark.sql.shuffle.partitions``, or more where the
    files read have more than ``CLUSTER_BYTES`` for each, so that a task's share does
    not grow with the input; ``parts`` is that of a table to be met in place. It is given openly:
    Spark 4.1 lets a union of parts clustered alike keep that clustering, and
    fails at run time if adaptive execution has coalesced one part and not the
    other. Parts of one table get one number.
    """
    return df.repartition(parts or cluster_parts(df), *keys)


def spread(spark: SparkSession, hashed: Column, parts: int) -> Column:
    """A number for each remainder of a hash, such that clustering by it into ``parts`` gives every remainder its own partition.

    Clustered by the remainder itself, some partitions would get several and others none.
    """
    home = F.pmod(F.hash("id"), F.lit(parts)).alias("_home")
    found = dict(spark.range(0, 32 * parts, 1, 1).groupBy(home).agg(F.min("id")).collect())
    homes = F.array(*[F.lit(found.get(i, i)) for i in range(parts)]).cast("array<bigint>")
    return F.get(homes, F.pmod(hashed, F.lit(parts)).cast("int"))


def cluster_blocks(df: DataFrame, *keys: str) -> DataFrame:
    """``cluster`` with the number of the partition as a column ``BLOCK``, which later steps may group by."""
    parts = cluster_parts(df)
    block = spread(df.sparkSession, F.hash(*keys), parts).alias(BLOCK, metadata={"parts": parts})
    return cluster(df.select("*", block), BLOCK, parts=parts)


def block_parts(df: DataFrame) -> int:
    """The number of partitions that ``cluster_blocks`` made."""
    return df.schema[BLOCK].metadata["parts"]
