"""Numbers and files that only one of several writers gets.

Several writers can add files to a table at the same time, and each file is there as a whole or not at all.
That is enough to claim something without a lock: a writer adds its claim and then looks at all claims. Of two
writers with the same claim at least one looks after both claims are there, so at least one sees the other, and
whoever sees another's claim withdraws. Both may do so; then a writer tries again, with a new number or after a while.

The store has to show a file to every reader as soon as it is written, as distributed file systems and
today's object stores do. A writer that breaks off leaves its claim; it runs out after ``LEASE_SECONDS``, which must
be longer than the work on one batch takes.
"""

from __future__ import annotations

import random
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headersieve.sources.stores import read_or_empty

CLAIMS = "kind string, name string, number bigint, token string, until timestamp, live boolean"
LEASE_SECONDS = 6 * 3600
TRIES = 4


class Claims:
    """The claims under ``path``, as one writer sees them."""

    def __init__(self, spark: SparkSession, path: str, lease: int = LEASE_SECONDS, pause=time.sleep) -> None:
        self.spark, self.path, self.lease, self.pause = spark, path, lease, pause
        self.token = uuid.uuid4().hex

    def _all(self, kind: str) -> DataFrame:
        return read_or_empty(self.spark, self.path, CLAIMS).filter(F.col("kind") == kind)

    def _add(self, kind: str, entries: list[tuple[str, int]], live: bool = True) -> None:
        rows = [(kind, name, number, self.token) for name, number in entries]
        table = self.spark.createDataFrame(rows, CLAIMS.rpartition(", until")[0])
        until = F.current_timestamp() + F.make_interval(secs=F.lit(self.lease))
        table = table.withColumns({"until": until, "live": F.lit(live)})
        table.coalesce(1).write.mode("append").parquet(self.path)

    def held(self, kind: str) -> DataFrame:
        """``name, number, token, abandoned`` of claims that nobody has given back."""
        each = self._all(kind).groupBy("name", "number", "token")
        held = each.agg(F.min("live").alias("live"), F.max("until").alias("until")).filter("live")
        return held.select("name", "number", "token", (F.col("until") <= F.current_timestamp()).alias("abandoned"))

    def draw(self, kind: str, least: int, first: int = 0, size: int = 1) -> tuple[int, int]:
        """A number from ``least`` on and the begin, from ``first`` on, of ``size`` ids; nobody else gets either.

        Numbers and ids that two writers drew at once are lost to both.
        """
        while True:
            name = F.max(F.col("name").cast("bigint")).alias("name")
            top = self._all(kind).agg(name, F.max("number").alias("id")).first()
            number = max(least, (top["name"] or 0) + 1)
            begin = first if top["id"] is None else max(first, top["id"] + 1)
            self._add(kind, [(str(number), begin + size - 1)])
            same = self._all(kind).filter(F.col("name") == str(number))
            if same.filter(F.col("token") != self.token).isEmpty():
                return number, begin
            self.pause(random.uniform(0.0, 0.5))

    def hold(self, kind: str, names: list[str], number: int = 0) -> list[str]:
        """Claim names, noting a number with them; gives those that nobody else holds."""
        for attempt in range(TRIES):
            if not names:
                break
            self._add(kind, [(name, number) for name in names])
            own = self.spark.createDataFrame([(name,) for name in names], "name string")
            others = self.held(kind).filter((F.col("token") != self.token) & ~F.col("abandoned"))
            taken = {row["name"] for row in others.join(own, "name", "left_semi").select("name").distinct().collect()}
            if not taken:
                return names
            self.release(kind, names, number)
            self.token = uuid.uuid4().hex
            names = [name for name in names if name not in taken]
            self.pause(random.uniform(0.0, 0.2 * 2**attempt))
        return []

    def release(self, kind: str, names: list[str], number: int = 0) -> None:
        """Give claimed names back, when the work on them is noted or given up."""
        if names:
            self._add(kind, [(name, number) for name in names], live=False)
