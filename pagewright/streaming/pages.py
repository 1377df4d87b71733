"""The page pipeline as a stream: pages arrive as files, their blocks and references leave batch by batch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators import html


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Pages of a Parquet file or folder as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def blocks_of(pages: DataFrame) -> DataFrame:
    return html.exploded(html.extract_pages(pages), "blocks")


def write_blocks(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Blocks of all pages that are there now, appended exactly once by the file sink."""
    return blocks_of(pages).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="pagewright-")


def blocks_per_page(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, blocks), counted over what the stream wrote."""
    folder = _folder(spark)
    write_blocks(_file_or_folder_stream(spark, path), f"{folder}/blocks", f"{folder}/checkpoint").awaitTermination()
    schema = blocks_of(spark.read.parquet(path)).schema
    return spark.read.schema(schema).parquet(f"{folder}/blocks").groupBy("page_id").agg(F.count("*").alias("blocks"))


def _file_or_folder_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream source reads folders; a single file is found through its folder and its name."""
    folder, name = path.rsplit("/", 1)
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if _is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", name).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).isDirectory()
