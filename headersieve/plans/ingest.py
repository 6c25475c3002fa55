"""Loading log files that have not been loaded yet."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from headersieve.operators.shred import REASONS, parse_log_lines, project_logs
from headersieve.sources import logs as L
from headersieve.sources.claims import LEASE_SECONDS, Claims
from headersieve.sources.signatures import Signatures
from headersieve.sources.stores import INGEST, LOGS, batch_path, read_logs, write_logs

# Compressed bytes of the files that are loaded as one batch; a larger file is a batch of its own.
BATCH_BYTES = 256 * 1024**3
# Ids that a partition of lines may use, as Spark numbers rows.
_PARTITION_IDS = 1 << 33


@dataclass
class IngestReport:
    """What a run loaded: its files and batches, and its lines ``read``, ``accepted`` and rejected by reason."""

    files: int = 0
    batches: list[int] = field(default_factory=list)
    lines: dict[str, int] = field(default_factory=dict)

    def add(self, files: int, batch: int | None, lines: dict[str, int]) -> None:
        self.files += files
        self.batches += [] if batch is None else [batch]
        for name, n in lines.items():
            self.lines[name] = self.lines.get(name, 0) + n


def choose_files(spark: SparkSession, source: str, ledger: DataFrame, mode: str) -> list[Row]:
    """The files to load, as rows ``(file_path, file_name, file_size)``.

    ``all`` skips loaded files. ``latest`` and ``one`` (``source`` is a file)
    take a single file and fail if it is loaded already. Only names come to the
    driver, as in any file listing.
    """
    if mode == "all":
        pending = L.pending_files(L.list_log_files(spark, source), ledger)
        return pending.orderBy("file_path").collect()
    if mode == "latest":
        L.require_latest(spark, source)
        chosen = L.latest_log_file(spark, source)
    elif mode == "one":
        chosen = L.list_log_files(spark, source, name_regex="")
    else:
        raise ValueError(f"unknown ingest mode {mode!r}")
    files = chosen.collect()
    if len(L.pending_files(chosen, ledger).collect()) < len(files):
        raise FileExistsError(f"file {_names(files)} is already loaded")
    return files


def _names(files: list[Row]) -> str:
    return ", ".join(row["file_name"] for row in files)


def cut_by_bytes(files: list[Row], most: int) -> list[list[Row]]:
    """The files, in order, in groups of up to ``most`` bytes; a larger file stands alone."""
    groups: list[list[Row]] = []
    size = 0
    for row in files:
        if not groups or size + row["file_size"] > most:
            groups.append([])
            size = 0
        groups[-1].append(row)
        size += row["file_size"]
    return groups


def ingest_pending(spark: SparkSession, source: str, store: str, signatures: Signatures, mode: str = "all",
                   **options) -> int:
    """Load pending files as ``ingest_files`` does; gives the number of files."""
    return ingest_files(spark, source, store, signatures, mode, **options).files


def ingest_files(
    spark: SparkSession,
    source: str,
    store: str,
    signatures: Signatures,
    mode: str = "all",
    start: int | None = None,
    finish: int | None = None,
    dry_run: bool = False,
    batch_bytes: int = BATCH_BYTES,
    lease: int = LEASE_SECONDS,
    **parse_options,
) -> IngestReport:
    """Load pending files into ``store``/logs and note them in ``store``/ledger, batch by batch.

    Runs on one store may overlap: files, batch numbers and ids are claimed first, so each goes to one run; in
    mode ``all`` files that another run holds are left to it. The ledger is written last. A run that fails gives its
    files back; the files of one that was killed can be loaded again when its claim has run out
    (``lease``), and what it left half-written is then replaced by nothing. A dry run parses and counts everything
    and keeps nothing.
    """
    report = IngestReport()
    ledger = L.read_ledger(spark, f"{store}/ledger")
    files = choose_files(spark, source, ledger, mode)
    options = {"start": start, "finish": finish, **parse_options}
    for group in cut_by_bytes(files, batch_bytes):
        if dry_run:
            lines = _number(spark, group, 0)
            report.add(len(group), None, _write(lines, store, 0, signatures, True, options))
            continue
        _load(spark, store, signatures, group, mode, lease, options, report)
    return report


def _load(spark, store, signatures, group, mode, lease, options, report) -> None:
    claims = Claims(spark, f"{store}/claims", lease)
    ledger = L.read_ledger(spark, f"{store}/ledger")
    last = ledger.agg(F.max("batch").alias("batch"), F.max("last_log_id").alias("id")).first()
    lines = L.read_header_logs(spark, [row["file_path"] for row in group], name_regex=None, recursive=False)
    ids = max(1, lines.rdd.getNumPartitions()) * _PARTITION_IDS
    batch, first_id = claims.draw("batch", (last["batch"] or 0) + 1, 0 if last["id"] is None else last["id"] + 1, ids)
    paths = claims.hold("file", [row["file_path"] for row in group], batch)
    try:
        _clear_abandoned(spark, store, claims, paths)
        # Another run may have noted some of the files after they were chosen and before they were claimed.
        held = [row for row in group if row["file_path"] in set(paths)]
        if held:
            noted = [(row["file_path"], row["file_name"]) for row in held]
            noted = spark.createDataFrame(noted, "file_path string, file_name string")
            fresh = {row["file_path"] for row in L.pending_files(noted, L.read_ledger(spark, f"{store}/ledger")).collect()}
            held = [row for row in held if row["file_path"] in fresh]
        if len(held) < len(group) and mode != "all":
            raise FileExistsError(f"file {_names(group)} is already loaded or being loaded")
        if held:
            counts = _write(_number(spark, held, first_id), store, batch, signatures, False, options)
            note_batch(spark, store, batch, first_id, held)
            report.add(len(held), batch, counts)
    finally:
        claims.release("file", paths, batch)


def _clear_abandoned(spark: SparkSession, store: str, claims: Claims, paths: list[str]) -> None:
    """Empty the batches that broken-off runs were writing these files to."""
    if not paths:
        return
    ledger = L.read_ledger(spark, f"{store}/ledger").select(F.col("batch").alias("number"))
    own = spark.createDataFrame([(path,) for path in paths], "name string")
    left = claims.held("file").filter("abandoned").join(own, "name", "left_semi").join(ledger, "number", "left_anti")
    for row in left.select("number").distinct().collect():
        none = spark.createDataFrame([], LOGS).drop("log_date")
        write_logs(none, f"{store}/logs", row["number"], owner=INGEST)


def _number(spark: SparkSession, files: list[Row], first_id: int) -> DataFrame:
    """The lines of files, numbered from ``first_id`` on."""
    lines = L.read_header_logs(spark, [row["file_path"] for row in files], name_regex=None, recursive=False)
    numbered = lines.withColumn("log_id", F.col("log_id") + F.lit(first_id))
    return L.spread_lines(spark, numbered, [row["file_size"] for row in files])


def _write(lines: DataFrame, store: str, batch: int, signatures: Signatures, dry_run: bool, options: dict) -> dict[str, int]:
    """Parse and write lines as one batch; gives the lines read, accepted and rejected, counted on the way."""
    counted = Observation("lines")
    parsed = parse_log_lines(lines, signatures, observation=counted, **options)
    logs = project_logs(parsed).withColumn("created_at", F.current_timestamp())
    write_logs(logs, f"{store}/logs", batch, dry_run, owner=INGEST)
    if not dry_run and read_logs(lines.sparkSession, batch_path(f"{store}/logs", INGEST, batch)).isEmpty():
        # With no row to write, adaptive execution drops the plan that counted; few lines are worth another look.
        return _write(lines, store, batch, signatures, True, options)
    counts = counted.get
    return {name: counts.get(name, 0) for name in ("read", "accepted", *REASONS)}


def note_batch(spark: SparkSession, store: str, batch: int, first_id: int, files: list[Row]) -> None:
    """Append the files of a written batch to the ledger."""
    written = read_logs(spark, batch_path(f"{store}/logs", INGEST, batch))
    top = written.agg(F.max("log_id").alias("id")).first()["id"]
    # No row at all means that every line of the batch was rejected.
    last_id = first_id if top is None else top
    rows = spark.createDataFrame(
        [(row["file_name"], row["file_path"], batch, last_id) for row in files],
        "file_name string, file_path string, batch bigint, last_log_id bigint",
    )
    noted = rows.withColumn("created_at", F.current_timestamp()).select(
        "file_name", "batch", "last_log_id", "created_at", "file_path"
    )
    noted.write.mode("append").parquet(f"{store}/ledger")
