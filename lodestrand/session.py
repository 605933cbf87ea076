"""Session set-up, the shared work area and size checks for broadcasts."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side may be broadcast; both are checked on the data before the hint is given.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def build_session(master: str = "local[*]", app: str = "lodestrand", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect; UTC is needed for timestamps."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, with pruning and pushdown left to the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; only where that is unset, a local one.

    The local one serves local mode. On a cluster the setting must be there, and its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="lodestrand-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


class Workspace:
    """Tables written to the shared folder to cut lineage: they outlive lost executors, unlike local checkpoints.

    Names are unique, so concurrent queries don't meet. Tables are removed by drop() or when the process ends.
    """

    def __init__(self, spark: SparkSession, purpose: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """df as a written table; the schema is passed on, so that reading needs no look at footers."""
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        try:
            self.drop()
        except Exception:  # the session may have ended before
            pass


def input_bytes(df: DataFrame) -> int:
    """The optimizer's sizes of what the plan reads, added up; joins don't multiply them, and unknown sizes count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def spread(df: DataFrame, each: int = 128 << 20, least: int | None = None) -> int:
    """Number of partitions of about so many bytes of input, at least one for each core."""
    least = df.sparkSession.sparkContext.defaultParallelism if least is None else least
    return max(least, math.ceil(input_bytes(df) / each))


_WIDTHS = {"bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8, "int": 4, "float": 4, "date": 4, "boolean": 1, "smallint": 2, "tinyint": 1, "void": 0}


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """The size of a value as it is: strings and binaries by their length, nested values by all they hold; null counts 0."""
    width = _WIDTHS.get(kind.simpleString())
    if width is not None or isinstance(kind, T.DecimalType):
        return F.lit(16 if width is None else width).cast("bigint")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        own = F.octet_length(value).cast("bigint") + 16
    elif isinstance(kind, T.ArrayType):
        inner = _WIDTHS.get(kind.elementType.simpleString())
        own = F.size(value).cast("bigint") * inner if inner is not None else F.aggregate(value, F.lit(0).cast("bigint"), lambda n, x: n + value_bytes(x, kind.elementType))
        own = own + 16
    elif isinstance(kind, T.MapType):
        own = value_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + value_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        own = F.lit(16).cast("bigint")
        for f in kind.fields:
            own = own + value_bytes(value[f.name], f.dataType)
    else:  # a type whose size isn't known counts as large
        own = F.lit(BROADCAST_BYTES).cast("bigint")
    return F.coalesce(own, F.lit(0).cast("bigint"))


def measured(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[int, int]:
    """Rows and bytes of df, by one job that goes no further than `rows` + 1 rows. Give it a written table where df is dear."""
    size = F.lit(16).cast("bigint")
    for f in df.schema.fields:
        size = size + value_bytes(df[f.name], f.dataType)
    found = df.select(size.alias("size")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return found[0], found[1]


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and at most so many bytes, both of the data themselves, not of an estimate."""
    counted, held = measured(df, rows)
    return counted <= rows and held <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its checked size allows it; else as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df
