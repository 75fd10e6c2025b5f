"""Event log: record construction, JSON-lines sink and source, last write wins, catalog table.

A record is written as it is made and again after it was sent on, so a log holds up to two lines of an
event. Line order means nothing to Spark: an event is told by its key, and the line with a log_id is the later one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import data
from ..functions.text import basename
from ..storage import exists

_LONG = ("timestamp", "level", "message", "source", "event_type", "user_action", "context", "stack_trace", "file_name", "line_number", "local_log_file", "synced_to_appwrite", "log_id")
_TYPES = {"user_action": T.BooleanType(), "synced_to_appwrite": T.BooleanType(), "line_number": T.IntegerType()}
SCHEMA = T.StructType([T.StructField(n, _TYPES.get(n, T.StringType())) for n in _LONG])
#: What the table demands; the rest may be null.
REQUIRED = [n for n in _LONG if n not in ("context", "stack_trace")]
KEY = ["timestamp", "file_name", "line_number", "message"]
LEVELS = ["INFO", "ERROR", "DEBUG", "WARNING", "CRITICAL"]
MESSAGE_CHARS = 512
_REFUSED = "refused record"


def category(c: Column) -> Column:
    """Unknown categories are `system`."""
    return F.when(c.isin(data.LOG_CATEGORIES), c).otherwise(F.lit("system"))


def records(df: DataFrame, level: Column, message: Column, source: Column, *, at: Column, file: Column, line: Column, category_col: Column | None = None, event_type: Column | None = None, user_action: Column | None = None, context: Column | None = None, stack_trace: Column | None = None) -> DataFrame:
    """Log records of the rows of df, with defaults, before they are sent on; column `category` says where they go."""
    where = category(F.coalesce(category_col if category_col is not None else F.lit(None), F.lit("system")))
    empty = F.lit("{}")
    columns = {
        "timestamp": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        "level": level,
        "message": message,
        "source": source,
        "event_type": F.coalesce(event_type if event_type is not None else F.lit(None), F.lit("general")),
        "user_action": F.coalesce(user_action if user_action is not None else F.lit(None), F.lit(False)),
        "context": F.coalesce(F.nullif(context, F.lit("")) if context is not None else F.lit(None), empty),
        "stack_trace": F.coalesce(stack_trace if stack_trace is not None else F.lit(None), F.lit("")),
        "file_name": basename(file),
        "line_number": line.cast("int"),
        "local_log_file": F.concat(where, F.lit(".log")),
        "synced_to_appwrite": F.lit(False),
        "log_id": F.lit(None).cast("string"),
    }
    return df.select(*(c.alias(k) for k, c in columns.items()), where.alias("category"))


def info(df: DataFrame, message: Column, source: Column, **more) -> DataFrame:
    return records(df, F.lit("INFO"), message, source, **more)


def error(df: DataFrame, message: Column, source: Column, *, stack_trace: Column, **more) -> DataFrame:
    """An error needs its trace."""
    return records(df, F.lit("ERROR"), message, source, stack_trace=stack_trace, **more)


def debug(df: DataFrame, message: Column, source: Column, **more) -> DataFrame:
    return records(df, F.lit("DEBUG"), message, source, **more)


def warning(df: DataFrame, message: Column, source: Column, **more) -> DataFrame:
    return records(df, F.lit("WARNING"), message, source, **more)


def critical(df: DataFrame, message: Column, source: Column, **more) -> DataFrame:
    return records(df, F.lit("CRITICAL"), message, source, **more)


def log_id() -> Column:
    """A stable id of an event, from its key."""
    return F.sha2(F.concat_ws("|", *(F.col(k).cast("string") for k in KEY)), 256)


def sent(df: DataFrame, ok: Column) -> DataFrame:
    """The second line of each event: an id, and whether sending worked."""
    return df.withColumn("log_id", log_id()).withColumn("synced_to_appwrite", ok)


def latest(lines: DataFrame) -> DataFrame:
    """One line an event: the one with a log_id if there is one."""
    rest = [c for c in lines.columns if c not in KEY]
    best = F.max_by(F.struct(*rest), F.struct(F.col("log_id").isNotNull(), F.col("synced_to_appwrite"), F.coalesce("log_id", F.lit(""))))
    return lines.groupBy(*KEY).agg(best.alias("__r")).select(*KEY, "__r.*").select(*lines.columns)


def append(df: DataFrame, folder: str) -> None:
    """Adds JSON lines under folder/category=..., creating it."""
    df.write.mode("append").partitionBy("category").json(folder)


def create(spark: SparkSession, folder: str) -> None:
    """An empty log of each category that has none yet."""
    for c in data.LOG_CATEGORIES:
        if not exists(spark, f"{folder}/category={c}"):
            spark.createDataFrame([], SCHEMA).write.mode("append").json(f"{folder}/category={c}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All lines; a context written as an object or as text is text."""
    return spark.read.schema(T.StructType([*SCHEMA.fields, T.StructField("category", T.StringType())])).json(folder)


def last_line(lines: DataFrame) -> DataFrame:
    """The line with the greatest key."""
    row = F.struct(*lines.columns)
    return lines.agg(F.max_by(row, F.struct(*KEY, F.col("log_id").isNotNull())).alias("r")).where("r is not null").select("r.*")


def create_table(spark: SparkSession, name: str) -> None:
    """The table of sent records, if there is none yet.

    Required columns are NOT NULL; Spark's own catalog takes file tables but forgets that, so the table's property `required` names them as well, and insert() holds them.
    """
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}{' not null' if f.name in REQUIRED else ''}" for f in SCHEMA.fields)
    spark.sql(f"create table if not exists {name} ({columns}) using parquet tblproperties ('required' = '{','.join(REQUIRED)}')")


def required_by(spark: SparkSession, name: str) -> list[str]:
    """Columns that a table demands."""
    named = [r["value"] for r in spark.sql(f"show tblproperties {name}").collect() if r["key"] == "required"]
    return named[0].split(",") if named else REQUIRED


def constrained(df: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """The columns of a record; a row that lacks a required one or whose message is too long fails the job that reads it.

    The condition is held where the row is written, in the same pass; Spark publishes nothing of a failed write.
    """
    held = {c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{_REFUSED}: {c} is null")).cast(SCHEMA[c].dataType)).otherwise(F.col(c)) for c in required}
    long = F.length("message") > MESSAGE_CHARS
    held["message"] = F.when(long, F.raise_error(F.lit(f"{_REFUSED}: a message is over {MESSAGE_CHARS} characters")).cast("string")).otherwise(held.get("message", F.col("message")))
    return df.select(*(held.get(c, F.col(c)).alias(c) for c in _LONG))


def insert(df: DataFrame, name: str) -> None:
    """Adds records to the table, all or none; required columns without a value are an error, long messages too."""
    try:
        constrained(df, required_by(df.sparkSession, name)).write.mode("append").insertInto(name)
    except Exception as e:
        if _REFUSED in str(e):
            raise ValueError(str(e).split("\n")[0]) from e
        raise


def catalog(spark: SparkSession) -> DataFrame:
    """(name) of the tables of the current database."""
    return spark.sql("show tables").select(F.col("tableName").alias("name"))


def read_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """All lines with `context` as VARIANT: an object, a text or nothing, as each line has it."""
    rest = [f for f in SCHEMA.fields if f.name != "context"]
    return spark.read.schema(T.StructType([*rest, T.StructField("context", T.VariantType()), T.StructField("category", T.StringType())])).json(folder)


def structured(lines: DataFrame, context_col: str = "context") -> DataFrame:
    """lines with the context (VARIANT or text) as one VARIANT whatever way it was written, and what it is.

    A text that holds JSON is taken as what it holds, since the second write of a record has its context as text. context_kind: object, array, text (no JSON), number, boolean or
    none (null, JSON's null or blank); context_text keeps what is text.
    """
    c = F.col(context_col)
    is_text = isinstance(lines.schema[context_col].dataType, T.StringType)
    plain = c if is_text else F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string"))
    inner = F.try_parse_json(plain)
    got = F.when(plain.isNotNull(), inner) if is_text else F.when(plain.isNull(), c).otherwise(inner)
    kind = F.schema_of_variant("__v")
    blank = F.coalesce(F.trim("__t") == "", F.lit(False))
    named = F.when(F.col("__v").isNull() & F.col("__t").isNotNull() & ~blank, "text").when(F.col("__v").isNull() | blank, "none").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "text").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "none").otherwise("number")
    out = lines.withColumns({"__t": plain if not is_text else c, "__v": got}).withColumn("context_kind", named)
    text = F.when(F.col("context_kind") == "text", F.coalesce(F.try_variant_get("__v", "$", "string"), "__t"))
    return out.withColumns({"context_value": F.when(F.col("context_kind").isin("text", "none"), None).otherwise(F.col("__v")), "context_text": text}).drop("__t", "__v")


def context_fields(lines: DataFrame, fields: dict[str, str]) -> DataFrame:
    """structured() lines with a typed column for each path of fields, path -> type; null where a context lacks it or it doesn't convert."""
    return lines.withColumns({path.strip("$.").replace(".", "_"): F.try_variant_get("context_value", path, kind) for path, kind in fields.items()})


def context_schema(lines: DataFrame) -> DataFrame:
    """(context_kind, n, fields): how many contexts there are of each kind and the type that holds all of them; contexts drift, so it is asked of the data."""
    return lines.groupBy("context_kind").agg(F.count("*").alias("n"), F.schema_of_variant_agg("context_value").alias("fields"))
