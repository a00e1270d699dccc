"""A landing directory as a stream: new containers are extracted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kistwerk.formats.extract import Options
from kistwerk.operators import containers as C
from kistwerk.plans import replay as R


def arriving(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """containers(path, content, modified) of files that land in the folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    return found.select("path", "content", F.col("modificationTime").alias("modified"))


def arriving_artifacts(containers: DataFrame, options: Options = Options()) -> DataFrame:
    """One row per artifact; append mode, without state."""
    return C.artifacts(C.extract_reports(containers, options))


def error_rates(files: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files and failures by code in windows of arrival time; rows later than the watermark are left out."""
    code = F.when(F.col("success"), "").otherwise(R.normal_code(F.col("error_code")))
    return files.withWatermark("modified", late).groupBy(F.window("modified", window), code.alias("code")).agg(F.count("*").alias("files"))
