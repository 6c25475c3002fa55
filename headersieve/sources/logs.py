"""Reading header logs and keeping the ingest ledger."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headersieve.operators.shred import raw_headers_with_crawlers
from headersieve.sources.stores import read_or_empty

LEDGER = "file_name string, batch bigint, last_log_id bigint, created_at timestamp, file_path string"


def list_log_files(spark: SparkSession, path: str, name_regex: str = "gz") -> DataFrame:
    """Files below ``path`` whose name contains a match: ``(file_path, file_name, file_size)``."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("_metadata.file_path", "_metadata.file_name", "_metadata.file_size")
    )
    return files.filter(F.col("file_name").rlike(name_regex))


def read_header_logs(
    spark: SparkSession, path: str | list[str], name_regex: str | None = "gz", recursive: bool = True
) -> DataFrame:
    """Lines of log files as ``(log_id, file_name, line)``, gzip or plain.

    ``path`` is a directory, a file or a list of files; only files whose name
    contains a match of ``name_regex`` are opened. One gzip file is unpacked by
    one task, however large; ``spread_lines`` shares out the work behind that.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("lineSep", "\n")
    if name_regex is not None and re.fullmatch(r"(?:[\w-]|\\\.)+", name_regex):
        # A plain text can be told to the file listing, so other files are not opened.
        text = name_regex.replace("\\.", ".")
        reader = reader.option("pathGlobFilter", f"*{text}*")
    lines = reader.text(paths)
    if name_regex is not None:
        lines = lines.filter(F.col("_metadata.file_name").rlike(name_regex))
    return lines.select(
        F.monotonically_increasing_id().alias("log_id"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("value").alias("line"),
    )


def spread_lines(spark: SparkSession, lines: DataFrame, sizes: list[int]) -> DataFrame:
    """Shuffle lines before they are parsed if their gzip files are few or uneven.

    A gzip file cannot be split, so a file much larger than a fair share would
    keep one task busy with all of its lines. Unpacking stays with that task;
    parsing, the costly part, is spread. Even files are left where they are.
    """
    tasks = spark.sparkContext.defaultParallelism
    fair = max(sum(sizes) / tasks, 32 * 1024 * 1024)
    if max(sizes, default=0) <= 2 * fair:
        return lines
    shuffled = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return lines.repartition(shuffled, "log_id")


def latest_log_file(spark: SparkSession, path: str, name_regex: str = "gz") -> DataFrame:
    """One row ``(file_path, file_name, file_size)``: the last file in lexical path order.

    An empty directory gives a row of nulls; ``require_latest`` turns it into an error.
    """
    files = list_log_files(spark, path, name_regex)
    newest = files.agg(F.max_by(F.struct(*files.columns), "file_path").alias("f"))
    return newest.select("f.*")


def require_latest(spark: SparkSession, path: str, name_regex: str = "gz") -> tuple[str, str]:
    row = latest_log_file(spark, path, name_regex).first()
    if row["file_path"] is None:
        raise FileNotFoundError(f"no files in path {path}")
    return row["file_path"], row["file_name"]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, LEDGER)


def pending_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that are not in the ledger yet.

    A file is known by its path: files of the same name in different folders are
    different files. Entries without a path, as older ledgers have them, stand
    for every file of that name.
    """
    if "file_path" in files.columns and "file_path" in ledger.columns:
        by_path = ledger.filter(F.col("file_path").isNotNull()).select("file_path")
        files = files.join(by_path, "file_path", "left_anti").select(*files.columns)
        ledger = ledger.filter(F.col("file_path").isNull())
    return files.join(ledger.select("file_name"), "file_name", "left_anti")


def preview_raw_headers(
    lines: DataFrame, n: int = 10, start: int | None = None, finish: int | None = None
) -> DataFrame:
    """Cleaned header JSON of the usable ones among the first ``n`` lines, by ``log_id``."""
    return raw_headers_with_crawlers(lines.orderBy("log_id").limit(n), start, finish)
