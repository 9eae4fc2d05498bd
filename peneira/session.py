"""Sessions, input tables and shared intermediate tables."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "peneira") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PENEIRA_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once an application; they may not have it in their path."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    aside = tempfile.mkdtemp(prefix="peneira-code-")
    archive = shutil.make_archive(os.path.join(aside, "peneira"), "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    atexit.register(shutil.rmtree, aside, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Parquet gives schema, pruning and pushdown."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan before work that is heavy on the processor: dealt out over the cores if its files give fewer tasks than half
    of them, as one small file does; a scan of many tasks, as at scale, is left as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() * 2 <= cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the session or its configuration names it. Where it is unset,
    a session whose executors are this very process (tests) gets a temporary one; a cluster without it is refused, as no
    folder of one machine is seen by all."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.applicationId not in _LOCAL:
        _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="peneira-")
        atexit.register(shutil.rmtree, _LOCAL[spark.sparkContext.applicationId], True)
    return _LOCAL[spark.sparkContext.applicationId]


_LOCAL: dict[str, str] = {}
# A bucketed table is written straight from its tasks as long as tasks times buckets give no more files than this.
FILES = 1 << 14


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df once as a Parquet table in the shared folder and reads it back.

    It cuts lineage, survives the loss of executors and, being columnar and
    compressed, takes less disk than checkpoint(). by: the column to bucket the
    table by, in as many buckets as a shuffle has partitions; aggregations and
    joins by that column then read it without a shuffle. Every task writes a
    file for each bucket, so beyond FILES the rows are shuffled by bucket
    first. The table is removed by released(), else when the driver ends.
    """
    spark = df.sparkSession
    key = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/peneira-{name}-{key}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if by is not None and df.rdd.getNumPartitions() * buckets > FILES:
        df = df.repartition(buckets, by)
    writer = df.write.option("compression", "zstd")
    if by is None:
        writer.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        remove = _remove_at_exit(spark, path)
    else:
        writer.bucketBy(buckets, by).option("path", path).format("parquet").saveAsTable(f"peneira_{name}_{key}")
        out = spark.table(f"peneira_{name}_{key}")
        remove = _remove_at_exit(spark, path, f"peneira_{name}_{key}")
    out._peneira_remove = remove
    return out


def released(*tables: DataFrame) -> None:
    """Removes tables that staged() gave and nothing reads any more, and lets Spark drop the shuffle files of jobs that are over."""
    for t in tables:
        t._peneira_remove()
        atexit.unregister(t._peneira_remove)
    gc.collect()
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def _remove_at_exit(spark: SparkSession, path: str, named: str | None = None):
    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            if named:
                spark.sql(f"drop table if exists {named}")
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass

    atexit.register(remove)
    return remove
