"""Tables that cut lineage, in the folder that the cluster shares.

``spark.checkpoint.dir`` names the folder. Where the session does not set it, a folder of the
local disk is used if the master is local; a cluster's executors would not share it, so there
it is an error. Results read their tables until they are written themselves; ``clear`` deletes
what this process wrote, also at its end.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a table is written: shuffle files go at the end of the query, which needs them no
#: more, and Arrow batches are small, since rows hold whole texts or sets.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "500"}
#: Most rows of ids that a broadcast may hold; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


#: Folders of this process.
_ROOTS: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Delete all written tables of this process; only once their results are written."""
    while _ROOTS:
        _delete(spark, _ROOTS.pop())


@contextmanager
def freed(spark: SparkSession):
    """Delete at the end what was written inside by operators of their own; what must stay goes to a ``Scratch`` made before."""
    before = len(_ROOTS)
    yield
    for root in _ROOTS[before:]:
        _delete(spark, root)
    del _ROOTS[before:]


@atexit.register
def _at_end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        clear(spark)


class Scratch:
    """Written tables of one operator run; ``drop`` frees one that nothing needs any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = f"file://{tempfile.gettempdir()}/marketloom-checkpoints"
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _ROOTS.append(self.root)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """``df`` written as Parquet and read again, with its schema."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in WRITING}
        try:
            for k, v in WRITING.items():
                conf.set(k, v)
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete written tables; only once what was made from them is itself written."""
        for df in tables:
            path = getattr(df, "_scratch_path", None)
            if path:
                _delete(self.spark, path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it has at most ``rows`` rows, else unchanged.

    For narrow tables of ids that are cheap to count (written tables).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
