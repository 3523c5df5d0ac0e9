"""Sources and sinks: tables, directories of tables, profiles, score reports."""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.functions.columns import col, nan_to_null, string_columns, to_number
from tabkit.operators.profile import PROFILE_SCHEMA, DatasetProfile


# Words that stand for a missing value in CSV text.
MISSING_WORDS = ["#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def _read(spark: SparkSession, paths: str | list[str], parquet: bool) -> DataFrame:
    if parquet:
        return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return _missing_words(spark.read.csv(paths, header=True, inferSchema=True, quote='"', escape='"', multiLine=True))


def _missing_words(df: DataFrame) -> DataFrame:
    """Words for a missing value become null; a text column whose other values are all numbers becomes numeric."""
    texts = string_columns(df)
    if not texts:
        return df
    df = df.withColumns({c: F.when(~col(c).isin(*MISSING_WORDS), col(c)) for c in texts})
    kinds = ("bigint", "double")
    seen = df.agg(*[F.count(x) for c in texts for x in (col(c), *[to_number(col(c)).cast("string") if k == "double" else col(c).try_cast(k) for k in kinds])]).first()
    typed = {}
    for i, c in enumerate(texts):
        some, whole, number = seen[3 * i : 3 * i + 3]
        if some and number == some:
            typed[c] = col(c).cast("bigint") if whole == some else to_number(col(c))
    return df.withColumns(typed) if typed else df


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet by suffix, otherwise CSV with a header. NaN becomes null.

    Without ``schema`` a CSV is read for its types first; words for missing values become null there. Quoted line breaks are kept, so
    each CSV file is one task: write large tables as Parquet, or as many files.
    """
    if not path.endswith(".parquet") and schema is not None:
        df = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)
    else:
        df = _read(spark, path, path.endswith(".parquet"))
    return nan_to_null(df)


def read_many(spark: SparkSession, paths: Sequence[str], schema=None) -> DataFrame:
    """Several files as one table with their path in ``source``.

    With ``schema`` all CSV files are one scan and none is read for its types.

    Files of one kind with one schema are one scan; differing schemas are
    united by column name, absent columns are null.
    """
    frames: list[DataFrame] = []
    for parquet in (True, False):
        group = [p for p in paths if p.endswith(".parquet") == parquet]
        if group and schema is not None and not parquet:
            df = spark.read.schema(schema).csv(group, header=True, quote='"', escape='"', multiLine=True)
            frames.append(nan_to_null(df.select("*", F.col("_metadata.file_path").alias("source"))))
            continue
        by_schema: dict[str, list[str]] = {}
        for p in group:
            by_schema.setdefault(_read(spark, p, parquet).schema.simpleString(), []).append(p)
        for same in by_schema.values():
            df = _read(spark, same, parquet)
            frames.append(nan_to_null(df.select("*", F.col("_metadata.file_path").alias("source"))))
    if not frames:
        raise ValueError("no input paths")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S3: a directory of Parquet or, for any other suffix, of CSV files with headers."""
    writer = df.write.mode(mode)
    if path.endswith(".parquet"):
        writer.parquet(path)
    else:
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def save_profile(profile: DatasetProfile, spark: SparkSession, path: str) -> None:
    """The profile table as JSON; domains and codes as Parquet beside it."""
    profile.to_df(spark).coalesce(1).write.json(os.path.join(path, "columns"), ignoreNullFields=False)
    for name, table in (("domains", profile.domains), ("codes", profile.codes)):
        if table is not None:
            table.write.parquet(os.path.join(path, name))


def load_profile(spark: SparkSession, path: str) -> DatasetProfile:
    """Read a saved profile back."""
    tables = [spark.read.parquet(p) if _exists(spark, p) else None for p in (os.path.join(path, "domains"), os.path.join(path, "codes"))]
    return DatasetProfile.from_df(spark.read.schema(PROFILE_SCHEMA).json(os.path.join(path, "columns")), *tables)


def read_scores(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Report files as ``(report, text)``, one row per file."""
    texts = spark.read.text(paths, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("report"), F.col("value").alias("text"))


def experiment_datasets(spark: SparkSession, specs: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Tables named by ``(experiment, dataset, path)`` as one; missing files are skipped with a warning."""
    out: DataFrame | None = None
    for experiment, dataset, path in specs:
        if not _exists(spark, path):
            warnings.warn(f"no file {path} for {experiment}/{dataset}; skipped", stacklevel=2)
            continue
        df = read_table(spark, path).select(F.lit(experiment).alias("experiment"), F.lit(dataset).alias("dataset"), "*")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError("none of the datasets exists")
    return out
