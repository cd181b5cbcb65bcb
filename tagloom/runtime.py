"""Session, tables, shared scratch folder and the handling of hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Keys that get salted in a salted join; a key outside the HOT_KEYS largest holds at most 1/HOT_KEYS of the rows.
HOT_KEYS = 512
SALTS = 32


def session(app: str = "tagloom", cores: str = "*", shuffle: int = 8, memory: str = "8g", folder: str | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session that is there.

    folder: what tables are written to between steps; a temporary one if it isn't given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", folder or tempfile.mkdtemp(prefix="tagloom-"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. Where none is set, a local session gets one; on a cluster that is an error,
    since a folder of one machine is none of the others'."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tagloom-"))
        conf = jsc.getCheckpointDir().get()
    return conf.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return a scan of it: the lineage ends there and survives lost executors.

    Unlike checkpoint() the files are columnar and compressed. They stay until purge()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tagloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete what written() left behind in this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tagloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot: DataFrame | None = None, merge: bool = False) -> DataFrame:
    """Equi-join left with right so that no task gets a hot key's rows alone.

    The HOT_KEYS most frequent keys of left (counted with map-side combining, or given in `hot` with the columns `on`) are
    spread over SALTS sub-keys; only right's rows of those keys are replicated. `hot` has at most HOT_KEYS rows, so it
    may be broadcast whatever the data's size. left should hold its rows' keys unaggregated; right should be unique in
    its keys or the replication multiplies by its rows for a hot key. how: inner, left or left_semi. Null keys match
    nothing, as in SQL."""
    if hot is None:
        hot = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").orderBy(F.desc("_n")).limit(HOT_KEYS)
    hot = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
    # The partition takes part, so that repeated rows are spread too; a task that runs again has the same one.
    own = [F.col(c).cast("string") for c in left.columns if left.schema[c].dataType.simpleString() in SIMPLE]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*own, F.spark_partition_id()), F.lit(SALTS)).cast("int")).otherwise(0)
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(hot, on, "left").withColumn("_salt", salt).drop("_hot")
    b = right.join(hot, on, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return a.join(b.hint("merge") if merge else b, [*on, "_salt"], how).drop("_salt")


#: Types of which a salt is made.
SIMPLE = {"string", "bigint", "int", "timestamp", "timestamp_ntz", "double", "boolean", "date", "binary", "float", "smallint"}


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes in fewer partitions than there are cores (one small file); at scale it is df itself.

    For what costs far more CPU a row than moving the row does. A plan with a shuffle of its own is left as it is: asking for its
    partitions would run it."""
    if df._jdf.queryExecution().executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def assert_empty(df: DataFrame, message: str) -> None:
    """Fail-closed constraint: raise if df has a row."""
    if row := df.take(1):
        raise ValueError(f"{message}: {row[0].asDict()}")


def exists(spark: SparkSession, sf_dir: str, name: str) -> bool:
    try:
        table(spark, sf_dir, name)
    except AnalysisException:
        return False
    return True
