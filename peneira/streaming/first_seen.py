"""First-seen state as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira.session import _remove_at_exit, shared_dir


def stream_first_seen(spark: SparkSession, path: str, key: str, at: str, base: str | None = None) -> DataFrame:
    """(key, first_seen) after a stream has taken all that lies at a path.

    The state is Spark's own: a streaming aggregation by key, in RocksDB. Each
    micro-batch gives only the keys it changed, written to a part of the log
    that carries the batch's number, so a batch replayed after a failure
    replaces its part. base: the folder of checkpoint and log; a stream that is
    started again with it goes on where it stopped, reading only what is new.
    Without it the folder is of this run and goes with it. Rows without a key
    are one key. An empty stream gives an empty state.
    """
    own = base or f"{shared_dir(spark)}/peneira-stream-{uuid.uuid4().hex}"
    if base is None:
        _remove_at_exit(spark, own)
    schema = spark.read.parquet(path).schema
    fields = f"{key} {schema[key].dataType.simpleString()}, {at} {schema[at].dataType.simpleString()}"
    told = fields.replace(f", {at} ", ", first_seen ")

    def log(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{own}/log/batch={number}")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # A file source takes a folder or a glob; a path to one file is such a glob.
    stream = spark.readStream.schema(fields).format("parquet").load(path + "*")
    changed = stream.groupBy(key).agg(F.min(at).alias("first_seen"))
    run = changed.writeStream.outputMode("update").foreachBatch(log).option("checkpointLocation", f"{own}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    if not _exists(spark, f"{own}/log"):
        return spark.createDataFrame([], told)
    return spark.read.schema(told).parquet(f"{own}/log").groupBy(key).agg(F.min("first_seen").alias("first_seen"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
