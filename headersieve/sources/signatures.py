"""Signature tables: loading them and joining them into lookups.

The signature source is a set of tables (client, operating system, device,
crawler and address lists). They describe software, not traffic, so they do not
grow with the logs; their sizes are still measured before anything relies on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headersieve.operators.lookup import Lookup
from headersieve.operators.pattern_index import PatternIndex

# Tables of a signature source and the columns read from each.
TABLES: dict[str, tuple[str, ...]] = {
    "client_class": ("id", "client_classification", "client_classification_code"),
    "client_list": (
        "id", "class_id", "name", "name_code", "homepage", "icon", "icon_big", "engine",
        "vendor", "vendor_code", "vendor_homepage", "uptodate_current_version",
    ),
    "client_regex": ("client_id", "sequence", "regstring"),
    "os_list": (
        "id", "family", "family_code", "name", "name_code", "homepage", "icon", "icon_big",
        "vendor", "vendor_code", "vendor_homepage",
    ),
    "os_regex": ("os_id", "sequence", "regstring"),
    "deviceclass_list": ("id", "name", "name_code", "icon", "icon_big"),
    "deviceclass_regex": ("deviceclass_id", "sequence", "regstring"),
    "crawler_class": ("id", "crawler_classification", "crawler_classification_code"),
    "crawler_list": (
        "id", "class_id", "name", "ver", "ver_major", "last_seen", "respect_robotstxt", "family",
        "family_code", "family_homepage", "family_icon", "vendor", "vendor_code",
        "vendor_homepage", "ua_string",
    ),
    "ip_class": ("id", "ip_classification", "ip_classification_code"),
    "ip_list": ("ip", "class_id", "crawler_id", "sequence"),
}
_KEYS = {"id", "class_id", "client_id", "os_id", "deviceclass_id", "crawler_id", "sequence"}

# Patterns up to this many are kept as a list, to be tried in place.
PATTERN_BLOCK = 64

# What is said about a pattern that is left out.
UNREADABLE = "not a regular expression that the engine can read"


def complete(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with every expected column; an absent text column is ``""``."""
    missing = sorted(set(TABLES) - set(tables))
    if missing:
        raise ValueError(f"signature source lacks tables: {', '.join(missing)}")

    def column(df: DataFrame, name: str) -> Column:
        if name in _KEYS:
            return F.col(name)
        if name not in df.columns:
            return F.lit("").alias(name)
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    return {
        table: tables[table].select(*(column(tables[table], name) for name in names))
        for table, names in TABLES.items()
    }


def read_signature_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Read a directory with one parquet table per signature table."""
    return complete({table: spark.read.parquet(f"{path}/{table}") for table in TABLES})


def read_signature_database(
    spark: SparkSession, url: str, prefix: str = "", **options: str
) -> dict[str, DataFrame]:
    """Read the signature tables over JDBC; the driver jar is the caller's to add."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    return complete({t: reader.option("dbtable", f"{prefix}{t}").load() for t in TABLES})


def clean_pattern(regstring: Column) -> Column:
    """Drop the ``/`` and ``/si`` around a stored pattern and ignore case."""
    bare = F.regexp_replace(F.regexp_replace(regstring, r"/si\z", ""), r"\A/", "")
    return F.concat(F.lit("(?i)"), bare)


def _regex_dim(regex: DataFrame, entry: DataFrame, foreign_key: str) -> DataFrame:
    joined = regex.join(entry, regex[foreign_key] == entry["id"]).drop("id")
    return joined.withColumn("pattern", clean_pattern(F.col("regstring")))


def dim_client_regex(tables: dict[str, DataFrame]) -> DataFrame:
    """Client patterns with the client and its class, to be tried by ``sequence``."""
    classes = tables["client_class"].withColumnRenamed("id", "class_id")
    clients = tables["client_list"].join(classes, "class_id")
    return _regex_dim(tables["client_regex"], clients, "client_id")


def dim_os_regex(tables: dict[str, DataFrame]) -> DataFrame:
    return _regex_dim(tables["os_regex"], tables["os_list"], "os_id")


def dim_device_regex(tables: dict[str, DataFrame]) -> DataFrame:
    return _regex_dim(tables["deviceclass_regex"], tables["deviceclass_list"], "deviceclass_id")


def dim_crawlers(tables: dict[str, DataFrame]) -> DataFrame:
    """Crawlers keyed by their exact agent text; the highest id wins a repeat."""
    classes = tables["crawler_class"].withColumnRenamed("id", "class_id")
    crawlers = tables["crawler_list"].join(classes, "class_id", "left").drop("class_id")
    fields = [c for c in crawlers.columns if c not in ("id", "ua_string")]
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in fields]
    return (
        crawlers.groupBy("ua_string")
        .agg(F.max_by(F.struct(F.col("id").alias("botid"), *text), F.col("id")).alias("c"))
        .select("ua_string", "c.*")
    )


def dim_ip_class(tables: dict[str, DataFrame]) -> DataFrame:
    """The class of each listed address; the highest sequence wins a repeat.

    The crawler tables add no column that is kept, and each address row meets at
    most one crawler and one crawler class, so those left joins change nothing
    and are left out. Aggregating before the class join would be wrong: a row
    without a class must not win.
    """
    classes = tables["ip_class"].withColumnRenamed("id", "class_id")
    listed = tables["ip_list"].join(classes, "class_id")
    code = "ip_classification_code"
    return listed.groupBy("ip").agg(
        F.max_by(code, F.struct("sequence", code)).alias(code)
    )


@dataclass(frozen=True)
class Rules:
    """Ordered patterns and what each says about an agent.

    ``patterns`` holds (id, pattern) in the order to try them if there are few
    enough to try them in place, else it is None and ``index`` finds the patterns
    that a text can match. ``rejected`` holds (id, pattern) the engine cannot read.
    """

    ordered: DataFrame
    described: Lookup
    patterns: list[tuple[int, str]] | None
    index: PatternIndex | None
    rejected: DataFrame


def is_readable(pattern: Column) -> Column:
    """Whether the regex engine accepts a pattern; it is asked by the tasks, not by the driver."""
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern)
    return compiled.isNotNull()


def load_rules(dim: DataFrame, id_column: str, block: int = PATTERN_BLOCK) -> Rules:
    """Sort out unreadable patterns; list the others if they are few, else index them."""
    facts = (
        dim.drop("sequence", "pattern", "regstring")
        .withColumn(id_column, F.col(id_column).cast("bigint"))
        .dropDuplicates([id_column])
    )
    described = Lookup.load(facts, id_column)
    every = dim.select("sequence", F.col(id_column).cast("bigint").alias("id"), "pattern")
    rejected = every.filter(~is_readable(F.col("pattern"))).select("id", "pattern")
    ordered = every.filter(is_readable(F.col("pattern")))
    head = ordered.orderBy("sequence", "id", "pattern").limit(block + 1).collect()
    if len(head) > block:
        return Rules(ordered, described, None, PatternIndex.build(ordered), rejected)
    return Rules(ordered, described, [(row["id"], row["pattern"]) for row in head], None, rejected)


@dataclass(frozen=True)
class Signatures:
    """Everything log rows are matched against, loaded and measured once."""

    clients: Rules
    systems: Rules
    devices: Rules
    crawlers: Lookup
    addresses: Lookup

    def crawlers_by_id(self) -> Lookup:
        """The crawlers keyed by their number, which stays among the fields."""
        table = self.crawlers.table
        return Lookup(table.withColumn("crawler_id", F.col("botid").cast("bigint")), "crawler_id", self.crawlers.small)

    def rejected_patterns(self, spark: SparkSession | None = None) -> DataFrame:
        """Patterns that were left out because the regex engine cannot read them."""
        kinds = {"client": self.clients, "os": self.systems, "device": self.devices}
        parts = [
            rules.rejected.select(F.lit(kind).alias("kind"), "id", "pattern", F.lit(UNREADABLE).alias("error"))
            for kind, rules in kinds.items()
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])


def load_signatures(tables: dict[str, DataFrame], block: int = PATTERN_BLOCK) -> Signatures:
    full = complete(tables)
    return Signatures(
        clients=load_rules(dim_client_regex(full), "client_id", block),
        systems=load_rules(dim_os_regex(full), "os_id", block),
        devices=load_rules(dim_device_regex(full), "deviceclass_id", block),
        crawlers=Lookup.load(dim_crawlers(full), "ua_string"),
        addresses=Lookup.load(dim_ip_class(full), "ip"),
    )
