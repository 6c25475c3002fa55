"""A dictionary of user agents that grows with the logs.

Trying patterns is the costly part of describing an agent, and most agents of a new batch of logs were
in earlier ones. The dictionary keeps what was found for each agent, as numbers of entries in the signature
tables. It is tied to the patterns by a fingerprint of them: other patterns start another dictionary, while
other names or links behind the numbers are seen at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headersieve.operators.match import AGENT_IDS, identify_agents
from headersieve.session import materialize
from headersieve.sources.signatures import Signatures
from headersieve.sources.stores import read_or_empty

AGENTS = f"user_agent string, {AGENT_IDS}"


def fingerprint(signatures: Signatures) -> str:
    """A name for what decides the numbers: patterns with their order, and crawler texts."""
    tables = [
        *(rules.ordered for rules in (signatures.clients, signatures.systems, signatures.devices)),
        signatures.crawlers.table.select("ua_string", "botid"),
    ]
    marks = []
    for table in tables:
        row = F.xxhash64(*table.columns)
        # The sum tells repeated rows apart, which cancel each other out in the other.
        marks.append(table.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(row.cast("decimal(20,0)"))).first())
    text = ";".join(",".join(map(str, mark)) for mark in marks)
    return signatures.crawlers.table.sparkSession.range(1).select(F.sha2(F.lit(text), 256)).first()[0][:24]


class AgentDictionary:
    """The agents known under ``path`` for one set of signatures.

    Writers that add at the same time may both add an agent; they give it the same numbers, and a reader takes
    one of the rows.
    """

    def __init__(self, spark: SparkSession, path: str, signatures: Signatures) -> None:
        self.spark, self.signatures = spark, signatures
        self.home = f"{path}/signatures={fingerprint(signatures)}"

    def known(self) -> DataFrame:
        """``user_agent`` and its numbers, each agent once."""
        return read_or_empty(self.spark, self.home, AGENTS).dropDuplicates(["user_agent"])

    def add(self, df: DataFrame) -> int:
        """Identify the agents of ``df`` that are not known yet; how many they were."""
        agents = df.select("user_agent").filter(F.col("user_agent").isNotNull()).distinct()
        known = read_or_empty(self.spark, self.home, AGENTS)
        fresh = materialize(agents.join(known, "user_agent", "left_anti"), "new_agents")
        found = fresh.count()
        if found:
            identified = identify_agents(fresh, self.signatures)
            identified.select(*(f.split()[0] for f in AGENTS.split(", "))).write.mode("append").parquet(self.home)
        return found
