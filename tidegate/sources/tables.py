"""Reading tables: Parquet, CSV, task specification and dataset preparation."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidegate import constants as K
from tidegate.functions.text import normalised_cell


class SpecError(ValueError):
    """The task or its table cannot be run."""


@dataclass(frozen=True)
class TaskSpec:
    target: str
    task_type: str = "binary"
    positive_label: str | None = None
    model_family: str = "linear"
    id_columns: tuple[str, ...] = ()
    drop_columns: tuple[str, ...] = ()

    def __post_init__(self):
        if self.task_type not in K.TASK_TYPES:
            raise SpecError(f"task_type {self.task_type} is not one of {K.TASK_TYPES}")
        if self.model_family not in K.MODEL_FAMILIES:
            raise SpecError(f"model_family {self.model_family} is not one of {K.MODEL_FAMILIES}")

    @property
    def gated(self) -> bool:
        return self.task_type == "binary"

    @property
    def excluded(self) -> tuple[str, ...]:
        return (*self.id_columns, *self.drop_columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_task_per_core(df: DataFrame) -> DataFrame:
    """Spread a table that lies in fewer files than there are cores, before CPU-heavy work on it.

    A table of many files is returned as it is: it needs no shuffle to be parallel.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; UTF-8, or Latin-1 when a line is not valid UTF-8; column names stripped.

    Give a schema for large files: inferring one reads them twice.
    """
    lines = spark.read.text(path)
    bad = lines.where(~F.is_valid_utf8("value")).limit(1).count() > 0
    reader = (spark.read.option("header", True).option("encoding", "ISO-8859-1" if bad else "UTF-8")
              .option("multiLine", False).option("quote", '"').option("escape", '"'))
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def normalise(df: DataFrame) -> DataFrame:
    """Text cells stripped, '?' and empty text to NULL, NaN to NULL: one projection."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = normalised_cell(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(out)


def canonical_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text form of columns; a float column whose values are all whole prints without fraction.

    "All whole" is a property of the column, found for every column in one aggregation.
    """
    floats = [c for c in columns if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    whole = df.agg(*[F.bool_and(F.col(c) == F.rint(c)).alias(c) for c in floats]).first() if floats else {}
    out = {}
    for c in columns:
        col: Column = F.col(c)
        if c in floats and whole[c]:
            col = col.cast("bigint")
        out[c] = F.trim(col.cast("string"))
    return df.withColumns(out)


def load_dataset(df: DataFrame, spec: TaskSpec, row_id: str | None = None) -> tuple[DataFrame, dict]:
    """Normalise, drop id and drop columns and rows without target; the target becomes text.

    ``row_id`` names an id column to keep as the row identity that folds and grading need.
    """
    raw = normalise(df)
    if spec.target not in raw.columns:
        raise SpecError(f"target {spec.target} is not a column")
    kept = raw.drop(*[c for c in spec.excluded if c != row_id])
    n = kept.agg(F.count("*").alias("rows"), F.count(spec.target).alias("labelled")).first()
    out = kept.where(F.col(spec.target).isNotNull())
    if spec.task_type != "regression":
        out = canonical_text(out, [spec.target])
    return out, {"dropped_columns": list(spec.excluded), "rows_in": n["rows"],
                 "rows_dropped_missing_target": n["rows"] - n["labelled"]}


def concat_files(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, matched by column name."""
    return reduce(DataFrame.unionByName, parts)


def feature_target(df: DataFrame, spec: TaskSpec, positive: str | None) -> DataFrame:
    """Features plus ``y``: 0/1 by the positive label, or the raw target for other tasks."""
    y = F.col(spec.target)
    if spec.task_type == "binary":
        y = is_positive(y, positive)
    return df.select(*[c for c in df.columns if c not in (spec.target, *spec.excluded)], y.alias("y"))


def is_positive(target: Column, positive: str) -> Column:
    return (F.trim(target.cast("string")) == F.lit(positive)).cast("int")
