"""Prepared datasets, vocabularies, reports and alerts on storage."""

from __future__ import annotations

from collections.abc import Mapping

from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession, functions as F

from anomaloom.sources.columns import FEATURE_KEYS, LABEL_KEYS, resolve_key
from anomaloom.sources.containers import opened, register

# --- fixed values ---------------------------------------------------------------------------
PAD, UNK = "<PAD>", "<UNK>"
PAD_ID, UNK_ID = 0, 1
SPLITS = ("train", "val", "test")
# --------------------------------------------------------------------------------------------


def write_dataset(df: DataFrame, path: str, metadata: Mapping[str, DataFrame] | None = None) -> None:
    """Rows under ``path/data`` partitioned by ``split``; every metadata table beside them."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    for name, table in (metadata or {}).items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_dataset(spark: SparkSession, path: str, x_key: str = "X", y_key: str = "y") -> DataFrame:
    """``X, y`` of a Parquet dataset under its own names or the usual aliases; one-element label
    arrays are flattened, other columns kept. A path that ends in ``.npz`` or ``.pt`` is read as an
    array container."""
    if path.endswith((".npz", ".pt")):
        return read_arrays(spark, path, x_key, y_key)
    rows = spark.read.parquet(path)
    x = resolve_key(rows.columns, x_key, FEATURE_KEYS, path)
    y = resolve_key(rows.columns, y_key, LABEL_KEYS, path)
    label = F.col(y)
    if rows.schema[y].dataType.typeName() == "array":
        label = F.element_at(label, 1)
    others = [name for name in rows.columns if name not in (x, y)]
    return rows.select(F.col(x).alias("X"), label.cast("bigint").alias("y"), *others)


def read_arrays(
    spark: SparkSession, path: str, x_key: str = "X", y_key: str = "y", feature_type: str = "float"
) -> DataFrame:
    """``X, y`` of an array container or of all containers of a folder; tasks read ranges of rows."""
    register(spark)
    options = {"xKey": x_key, "yKey": y_key, "featureType": feature_type}
    return spark.read.format("arrays").options(**options).load(path)


def write_arrays(df: DataFrame, path: str, mode: str = "errorifexists", compressed: bool = False) -> None:
    """Every column as an array of that name in ``.npz`` files under ``path``; no nulls, even lists."""
    register(df.sparkSession)
    if mode == "errorifexists":
        store, place = opened(path)
        if store.get_file_info(place).type != FileType.NotFound:
            raise FileExistsError(path)
        mode = "append"
    df.write.format("arrays").mode(mode).option("compressed", str(compressed).lower()).save(path)


def load_split(df: DataFrame, name: str, column: str = "split") -> DataFrame:
    """One split (a partition filter on a written dataset); a missing one is an error."""
    part = df.where(F.col(column) == name)
    if part.isEmpty():
        raise KeyError(f"missing split {name!r}")
    return part


def read_vocab(spark: SparkSession, path: str, field: str = "vocab") -> DataFrame:
    """``token, token_id`` from a JSON document with a token map under ``field``."""
    document = spark.read.text(path, wholetext=True)
    return parse_vocab(document.select(F.get_json_object("value", f"$.{field}").alias("vocab")), "vocab")


def parse_vocab(df: DataFrame, column: str) -> DataFrame:
    """Explode a JSON token map; ids that are no whole numbers are skipped, the two special tokens
    added where they are missing."""
    entries = df.select(
        F.explode(F.from_json(column, "map<string,string>")).alias("token", "raw")
    ).select("token", F.col("raw").try_cast("int").alias("token_id"))
    known = entries.where(F.col("token_id").isNotNull())
    special = df.sparkSession.createDataFrame(
        [(PAD, PAD_ID), (UNK, UNK_ID)], "token string, token_id int"
    )
    return known.unionByName(special.join(known, "token", "left_anti"))


def write_json_rows(df: DataFrame, path: str) -> None:
    """Reports or alerts as JSON lines."""
    df.write.mode("overwrite").json(path)


write_metrics_report = write_json_rows
write_alerts = write_json_rows


def read_metrics_report(spark: SparkSession, path: str, pretty: bool = False) -> DataFrame:
    """JSON reports in lines, or with ``pretty`` one document per file over several lines."""
    return spark.read.option("multiLine", pretty).json(path)
