"""Sources and sinks. Paths are Spark's own, so any store that the cluster reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File kinds of the inbox.
SUFFIXES = ("pdf", "jpg", "jpeg", "png", "webp", "tif", "tiff", "heic", "heif")
GOLD = ("cases array<struct<id:string,path:string,kind:string,fields:struct<emisor_contains:array<string>,nif_emisor:string,nif_receptor:string,numero:string,"
        "fecha:string,base:string,iva_cuota:string,total:string,iva_tipo:string>,must_tokens:array<string>>>")


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder, not of those below it: path, name, size and content hash, without hidden files and other kinds."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return (files.withColumn("nombre", name).where(F.lower(F.element_at(F.split("nombre", r"\."), -1)).isin(*SUFFIXES) & ~F.startswith("nombre", F.lit(".")))
            .select("path", "nombre", "length", F.sha2("content", 256).alias("sha256")))


def gold_suite(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON suite, one row each."""
    return spark.read.schema(GOLD).option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")


def suite_with_override(extra: DataFrame, suite: DataFrame) -> DataFrame:
    """The suite with some cases replaced or added."""
    return extra.unionByName(suite.join(extra.select("id"), "id", "left_anti"))


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolon CSV with header; quotes only where needed."""
    df.write.mode("overwrite").option("sep", ";").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """One CSV folder for each sheet."""
    for name, df in sheets.items():
        write_csv(df, f"{path}/{name}")


def write_entries(entries: DataFrame, path: str) -> None:
    """Snapshot laid out by case file and year, which every report filters on."""
    entries.write.mode("overwrite").partitionBy("actividad_id", "ejercicio").parquet(path)


def split_errors(df: DataFrame, error_col: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows)."""
    return df.where(F.col(error_col).isNull()).drop(error_col), df.where(F.col(error_col).isNotNull())
