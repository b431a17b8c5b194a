"""Session set-up and lineage cuts."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession


def get_spark(app: str = "surveyspark", **conf: str) -> SparkSession:
    """Session with AQE on; cluster settings given to ``spark-submit`` win over these."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only on local masters."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to storage that every executor can reach.")
        folder = tempfile.mkdtemp(prefix="surveyspark-")
        context.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later passes read the written table, so a lost executor costs a re-read, not a recomputation
    of everything upstream, and the optimizer sees real sizes.  ``compression`` names a Parquet codec other than the session's.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/surveyspark-tables/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, metrics: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` with aggregates that the next write of it computes on the way."""
    observation = Observation(f"o{uuid.uuid4().hex}")
    return df.observe(observation, *[c.alias(n) for n, c in metrics.items()]), observation


def materialise_observed(df: DataFrame, metrics: Mapping[str, Column]) -> tuple[DataFrame, dict]:
    """:func:`materialise`, and aggregates of the rows taken during the write."""
    watched, observation = observed(df, metrics)
    return materialise(watched), observation.get


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Wide rows are derived by methods that the JVM compiles: it interprets methods of over 8,000 bytes, as one stage for all columns would be.

    Spark then evaluates such a stage by smaller methods.  A lower limit of the session stays, and the session's own comes back at the end.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 8000)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class RunFolder:
    """The written tables of one run, with a manifest of what is finished.

    A table whose manifest entry exists is read instead of made, so a run that was killed goes on after its last finished
    table when it is given the same folder.  ``remove`` deletes everything at the end.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or f"{shared_folder(spark).rstrip('/')}/surveyspark-runs/{uuid.uuid4().hex}").rstrip("/")

    def _file(self, path: str):
        java = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return java, java.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def finished(self, name: str) -> bool:
        path, system = self._file(f"{self.path}/{name}.done/_SUCCESS")
        return system.exists(path)

    def table(self, name: str, make: Callable[[], tuple[DataFrame, Sequence[Observation]]]) -> tuple[DataFrame, dict]:
        """The table ``name`` and what was observed during its write; ``make`` is called only if it isn't finished."""
        if not self.finished(name):
            df, observations = make()
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
            facts = {k: v for o in observations for k, v in o.get.items()}
            self.spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}.done")
        facts = json.loads(self.spark.read.text(f"{self.path}/{name}.done").first()[0])
        return self.spark.read.parquet(f"{self.path}/{name}"), facts

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """:meth:`table` without observations."""
        return self.table(name, lambda: (make(), ()))[0]

    def remove(self) -> None:
        path, system = self._file(self.path)
        system.delete(path, True)


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def small_table(spark: SparkSession, rows: Sequence[tuple], columns: str) -> DataFrame:
    """A table written in the program, such as labels or table specifications.

    It becomes a local relation of known size, so Spark broadcasts it by itself; rows made from Python
    objects would be an RDD of unknown size and be shuffled.
    """
    fields = [c.split() for c in columns.split(",")]
    arrays = [pa.array([r[i] for r in rows], _ARROW[kind]) for i, (_, kind) in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=[name for name, _ in fields]))
