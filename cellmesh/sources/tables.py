"""Tables in, sketches out and in: Parquet is the snapshot format of every sketch."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ddsketch import DDSketch, Mapping
from ..operators.frames import Mismatch
from ..operators.heavy import Coco, Elastic
from ..operators.hll import HLL
from ..operators.hydra import Hydra
from ..operators.kll import KLL
from ..operators.linear import Linear, Shape, Tally
from ..operators.tracked import Tracked
from ..operators.univmon import Pyramid, UnivMon
from ..operators.windows import Hybrid


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table as a stream of its files: those of its folder, or its one file.  A table that is not there is an error.

    With ``files_per_batch`` a micro-batch takes so many files, oldest first: see :func:`in_order`.
    """
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(read(spark, sf_dir, name).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(found)
    # File streams watch folders; a glob of one name is the folder of one file.
    return reader.parquet(path) if status.isDirectory() else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def in_order(spark: SparkSession, path: str) -> str:
    """Give a table's data files times in the order of their names, a second apart; returns ``path``.

    Tasks write files side by side, so their own times follow no order.  A stream reads a folder by time: after this it reads a table that was
    dealt by range in that range's order, and a watermark drops nothing.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f for f in fs.listStatus(folder) if f.isFile() and not f.getPath().getName().startswith(("_", "."))), key=lambda f: f.getPath().getName())
    last = max((f.getModificationTime() for f in files), default=0)
    for k, f in enumerate(files):
        fs.setTimes(f.getPath(), last - 1000 * (len(files) - 1 - k), -1)
    return path


def packets(df: DataFrame, key: str, order: str) -> DataFrame:
    """``(seq, key)``: any table as a trace of keys in order."""
    return df.select(F.col(order).alias("seq"), F.col(key).cast("string").alias("key"))


#: What a snapshot may hold: sketches, and the parameters in them.
SKETCHES = {c.__name__: c for c in (Linear, Tally, HLL, DDSketch, KLL, Coco, Elastic, UnivMon, Hydra, Hybrid, Tracked)}
PARAMETERS = {c.__name__: c for c in (Shape, Mapping, Pyramid)}


def _flat(sketch: object, at: str = "") -> tuple[dict, dict[str, DataFrame]]:
    """A sketch's parameters, and its tables by the folder that they go to; sketches inside it come along."""
    rest, tables = {"_type": type(sketch).__name__}, {}
    for name, value in vars(sketch).items():
        if isinstance(value, DataFrame):
            tables[f"{at}{name}"] = value
        elif type(value).__name__ in SKETCHES:
            rest[name], inner = _flat(value, f"{at}{name}/")
            tables |= inner
        else:
            rest[name] = {"_type": type(value).__name__, **dataclasses.asdict(value)} if dataclasses.is_dataclass(value) else value
    return rest, tables


def save(sketch: object, path: str, mode: str = "errorifexists") -> None:
    """Write a sketch's tables and its parameters.  Buckets of a window are saved as the sketch that is grouped by them."""
    if type(sketch).__name__ not in SKETCHES:
        raise TypeError(f"no snapshot of {type(sketch).__name__}")
    rest, tables = _flat(sketch)
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    meta = spark.createDataFrame([(json.dumps(rest, sort_keys=True),)], "parameters string")
    meta.coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> object:
    """Read what :func:`save` wrote."""
    return _made(spark, path, json.loads(spark.read.parquet(f"{path}/meta").first()["parameters"]))


def _made(spark: SparkSession, path: str, rest: dict) -> object:
    kind = rest.pop("_type", None)
    if kind in PARAMETERS:
        return PARAMETERS[kind](**rest)
    if kind not in SKETCHES:
        raise Mismatch(f"no sketch {kind}")
    made = SKETCHES[kind]
    values = {k: _made(spark, f"{path}/{k}", dict(v)) if isinstance(v, dict) else tuple(v) if k == "by" else v for k, v in rest.items()}
    return made(**values, **{f.name: spark.read.parquet(f"{path}/{f.name}") for f in dataclasses.fields(made) if f.name not in values})


def json_points(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Each point as ``[seconds, "value"]``."""
    return df.withColumn("json", F.concat(F.lit("["), (F.col(ts).cast("bigint") / 1000).cast("string"), F.lit(',"'), F.col(value).cast("string"), F.lit('"]')))


def read_points(df: DataFrame, json: str) -> DataFrame:
    """``df`` with ``seconds`` and ``value`` of points in the place of their text; what is no point is null."""
    point = F.from_json(F.col(json), "array<string>")
    return df.withColumns({"seconds": F.get(point, F.lit(0)).cast("double"), "value": F.get(point, F.lit(1))}).drop(json)
