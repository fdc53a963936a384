"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from webloom.session import bound_batches, checkpoint_dir, ship_package

#: Rows whose Python values are alive at once inside a task; Arrow batches are cut to this.
SLICE_ROWS = 256
_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, removed when the driver's Python ends."""
    path = f"{checkpoint_dir(spark)}/webloom-llm/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_clean)
    _SCRATCH.append((spark, path))
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            drop_scratch(spark, path)
        except Exception:  # noqa: BLE001  the session is gone: the cluster owns the folder
            return


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back. A lost executor then
    costs a re-read, and the plan above is not run again by each consumer (``checkpoint()`` runs it twice). ``options`` are the writer's."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Columns of ``df`` but those whose name (in any case) is in ``names``."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def map_values(df: DataFrame, value: Column, out: T.StructType, fn: Callable[[], Callable[[list], list[list]]],
               keep: list[str]) -> DataFrame:
    """Arrow map over one value column. ``fn()`` runs once per task and returns a function from a list of values
    (None for null) to one list per field of ``out``. ``keep`` columns pass through unless an output has their name."""
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)
    kept = [c for c in keep if c.lower() not in {f.name.lower() for f in out}]
    src = df.select(*[quoted(c) for c in kept], value.alias("__value"))
    schema = T.StructType([src.schema[c] for c in kept] + list(out))
    arrow = to_arrow_schema(schema)
    fields = [arrow.field(f.name) for f in out]

    def run(batches):
        work = fn()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = work(part.column(part.num_columns - 1).to_pylist())
                cols = [part.column(i) for i in range(len(kept))]
                cols += [pa.array(v, f.type) for v, f in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return src.mapInArrow(run, schema)
