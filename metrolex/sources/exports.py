"""Export sinks by format name, the workspace layout and the configuration table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .. import data
from ..storage import exists, make_folder
from ..tables import table
from . import xlsx

#: Folders of a workspace, below its root.
FOLDERS = ["raw_inputs", "extracted_xml", "samples", "models", "exports/txt", "exports/csv", "exports", "logs", "data", "config"]


def formats(spark: SparkSession) -> DataFrame:
    return table(spark, data.EXPORT_FORMATS, "name string, extension string, mime_type string")


def export(df: DataFrame, path: str, name: str, mode: str = "errorifexists") -> None:
    """Writes df in one of the registered formats; txt takes one string column, xlsx flat columns."""
    if name not in {f[0] for f in data.EXPORT_FORMATS}:
        raise ValueError(f"unknown export format {name}")
    writer = df.write.mode(mode)
    if name == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif name == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif name == "xml":
        writer.format("xml").option("rowTag", "row").save(path)
    elif name == "xlsx":
        if mode not in ("append", "overwrite") and exists(df.sparkSession, f"{path}/_SUCCESS"):
            if mode == "ignore":
                return
            raise ValueError(f"{path} is there already")
        xlsx.register(df.sparkSession)
        df.write.format("xlsx").mode("overwrite" if mode == "overwrite" else "append").save(path)
    else:
        writer.text(path)


def read_export(spark: SparkSession, path: str, name: str, schema: StructType | None = None) -> DataFrame:
    """Reads what export() wrote; without a schema the columns are as the format has them."""
    if name not in {f[0] for f in data.EXPORT_FORMATS}:
        raise ValueError(f"unknown export format {name}")
    if name == "xlsx":
        xlsx.register(spark)
    reader = spark.read.format("text" if name == "txt" else name)
    options = {"csv": {"header": True, "escape": '"'}, "xml": {"rowTag": "row"}, "txt": {}, "json": {}, "xlsx": {}}[name]
    return (reader.schema(schema) if schema is not None else reader).options(**options).load(path)


def ensure_workspace(spark: SparkSession, root: str) -> list[str]:
    """Creates the folders of a workspace on any file system that Spark reaches."""
    out = [f"{root}/{f}" for f in FOLDERS]
    for f in out:
        make_folder(spark, f)
    return out


def configuration(spark: SparkSession, root: str, **ids: str) -> DataFrame:
    """(name, value): the workspace's paths and the ids of remote collections."""
    return table(spark, [(f, f"{root}/{f}") for f in FOLDERS] + sorted(ids.items()), "name string, value string")
