"""Describing user agents and addresses by the signature tables.

The costly part is trying ordered patterns on agent texts. With few patterns
they are tried in place on each row, without a shuffle. With many, each distinct
agent meets only the patterns an index finds for it, and what was found is
joined back as five numbers; the descriptions are attached from small lookups.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headersieve.functions import fixed_values as V
from headersieve.functions.addresses import ip_version
from headersieve.operators.lookup import Lookup, attach, lookup_join
from headersieve.operators.pattern_index import match_texts
from headersieve.session import materialize
from headersieve.sources.signatures import Rules, Signatures

if TYPE_CHECKING:
    from headersieve.sources.agents import AgentDictionary

# Up to this many patterns in all are tried on each row in place.
INLINE_PATTERNS = 64

#: What is known of an agent: numbers of its entries in the signature tables, and its version.
AGENT_IDS = "crawler_id bigint, client_id bigint, version string, os_id bigint, device_id bigint"


def first_match(text: Column, patterns: list[tuple[int, str]]) -> Column:
    """The first pattern found in ``text`` as struct (id, version), null if none is.

    The version is the pattern's first group. The empty group added behind the
    pattern makes sure there is one, so a pattern without groups gives ``""``.
    """
    none = F.lit(None).cast("struct<id:bigint,version:string>")
    tries = [
        F.when(
            text.rlike(pattern),
            F.struct(
                F.lit(number).cast("bigint").alias("id"),
                F.regexp_extract(text, pattern + "()", 1).alias("version"),
            ),
        )
        for number, pattern in patterns
    ]
    return F.coalesce(*tries, none)


def match_rules(df: DataFrame, rules: Rules, text: Column, name: str) -> DataFrame:
    """Add ``name``, the first match of ``text`` among the rules.

    A few patterns are tried in place. More are matched by their index against
    the distinct texts, and only what was found is joined back: ``df`` itself is
    neither written nor moved unless the distinct texts are too many to broadcast.
    """
    if rules.patterns is not None:
        return df.withColumn(name, first_match(text, rules.patterns))
    if df.isStreaming:
        raise ValueError("many patterns need a batch: use them in foreachBatch, as the streaming plans do")
    texts = df.select(text.alias("text")).filter(F.col("text").isNotNull()).distinct()
    hits = materialize(match_texts(materialize(texts, "texts"), rules.index).filter("hit is not null"), name)
    lookup = Lookup.measure(hits.select(F.col("text").alias("__text"), F.col("hit").alias(name)), "__text")
    return lookup_join(df, lookup, text)


def match_crawler_ua(df: DataFrame, signatures: Signatures) -> DataFrame:
    """Add ``crawler``, the crawler whose agent text is exactly ``user_agent``."""
    return attach(df, signatures.crawlers, F.nullif("user_agent", F.lit("")), "crawler")


def _matchable(df: DataFrame) -> Column:
    """The agent text, null where it is empty or already known as a crawler."""
    wanted = F.col("user_agent") != ""
    if "crawler" in df.columns:
        wanted = wanted & F.col("crawler").isNull()
    return F.when(wanted, F.col("user_agent"))


def _match_and_attach(df: DataFrame, rules: Rules, name: str) -> DataFrame:
    hit = f"{name}_hit"
    matched = match_rules(df, rules, _matchable(df), hit)
    return attach(matched, rules.described, F.col(f"{hit}.id"), name)


def match_client_regex(df: DataFrame, signatures: Signatures) -> DataFrame:
    """Add ``client_hit`` (id, version) and ``client``, the matched client."""
    return _match_and_attach(df, signatures.clients, "client")


def match_os_regex(df: DataFrame, signatures: Signatures) -> DataFrame:
    """Add ``os_hit`` and ``os``, the matched operating system."""
    return _match_and_attach(df, signatures.systems, "os")


def match_device_regex(df: DataFrame, signatures: Signatures) -> DataFrame:
    """Add ``device_hit`` and ``device``, the matched device class."""
    return _match_and_attach(df, signatures.devices, "device")


def _agent_record() -> Column:
    """The agent record from what was matched; ``""`` where nothing was."""
    is_crawler = F.col("crawler").isNotNull()
    is_client = F.col("client").isNotNull()

    def either(crawler: str | None, client: str | None) -> Column:
        found = F.lit(None).cast("string")
        if client is not None:
            found = F.when(is_client, F.col(f"client.{client}")).otherwise(found)
        if crawler is not None:
            found = F.when(is_crawler, F.col(f"crawler.{crawler}")).otherwise(found)
        return F.coalesce(found, F.lit(""))

    def prefixed(source: Column, prefix: str, *parts: Column) -> Column:
        return F.when(source, F.concat(F.lit(prefix), *parts))

    def of(table: str, field: str) -> Column:
        return F.coalesce(F.col(f"{table}.{field}"), F.lit(""))

    def agent_class(crawler: str, client: str, unknown: str) -> Column:
        return (
            F.when(F.col("user_agent") == "", "")
            .when(is_crawler, crawler)
            .when(is_client, F.col(f"client.{client}"))
            .otherwise(unknown)
        )

    version = F.coalesce(
        F.when(is_crawler, F.col("crawler.ver")).otherwise(F.col("client_hit.version")), F.lit("")
    )
    name = either("name", "name")
    info = F.coalesce(
        prefixed(
            is_crawler, V.BOT_INFO_URL, F.col("crawler.family"), F.lit("#id"),
            F.col("crawler.botid").cast("string"),
        ),
        prefixed(is_client, V.BROWSER_INFO_URL, F.col("client.name")),
        F.lit(""),
    )
    fields = {
        "ua_string": F.col("user_agent"),
        "ua_class": agent_class(
            V.CRAWLER_CLASS[0], "client_classification", V.UNRECOGNIZED_CLASS[0]
        ),
        "ua_class_code": agent_class(
            V.CRAWLER_CLASS[1], "client_classification_code", V.UNRECOGNIZED_CLASS[1]
        ),
        "ua": F.when(version != "", F.concat(name, F.lit(" "), version)).otherwise(name),
        "ua_version": version,
        "ua_version_major": F.substring_index(version, ".", 1),
        "ua_uptodate_current_version": either(None, "uptodate_current_version"),
        "ua_family": either("family", "name"),
        "ua_family_code": either("family_code", "name_code"),
        "ua_family_homepage": either("family_homepage", "homepage"),
        "ua_family_vendor": either("vendor", "vendor"),
        "ua_family_vendor_code": either("vendor_code", "vendor_code"),
        "ua_family_vendor_homepage": either("vendor_homepage", "vendor_homepage"),
        "ua_family_icon": either("family_icon", "icon"),
        "ua_family_icon_big": either(None, "icon_big"),
        "ua_family_info_url": info,
        "ua_engine": either(None, "engine"),
        "os": of("os", "name"),
        "os_code": of("os", "name_code"),
        "os_homepage": of("os", "homepage"),
        "os_icon": of("os", "icon"),
        "os_icon_big": of("os", "icon_big"),
        "os_info_url": F.coalesce(
            prefixed(F.col("os").isNotNull(), V.OS_INFO_URL, F.col("os.name")), F.lit("")
        ),
        "os_family": of("os", "family"),
        "os_family_code": of("os", "family_code"),
        "os_family_vendor": of("os", "vendor"),
        "os_family_vendor_code": of("os", "vendor_code"),
        "os_family_vendor_homepage": of("os", "vendor_homepage"),
        "device_class": of("device", "name"),
        "device_class_code": of("device", "name_code"),
        "device_class_icon": of("device", "icon"),
        "device_class_icon_big": of("device", "icon_big"),
        "device_class_info_url": F.coalesce(
            prefixed(F.col("device").isNotNull(), V.DEVICE_INFO_URL, F.col("device.name")), F.lit("")
        ),
        "crawler_last_seen": either("last_seen", None),
        "crawler_category": either("crawler_classification", None),
        "crawler_category_code": either("crawler_classification_code", None),
        "crawler_respect_robotstxt": either("respect_robotstxt", None),
    }
    return F.struct(*(column.alias(field) for field, column in fields.items()))


def _described(matched: DataFrame, kept: list[str]) -> DataFrame:
    return matched.select(*kept, _agent_record().alias("ua"))


def describe_user_agents(df: DataFrame, signatures: Signatures) -> DataFrame:
    """Add ``ua``, the agent record of ``user_agent``, row by row."""
    matched = match_crawler_ua(df, signatures)
    matched = match_client_regex(matched, signatures)
    matched = match_os_regex(matched, signatures)
    matched = match_device_regex(matched, signatures)
    return _described(matched, df.columns)


def identify_agents(agents: DataFrame, signatures: Signatures) -> DataFrame:
    """``user_agent`` and ``AGENT_IDS`` of distinct agents."""
    found = match_crawler_ua(agents.select("user_agent"), signatures)
    for rules, name in (
        (signatures.clients, "client"), (signatures.systems, "os"), (signatures.devices, "device")
    ):
        found = match_rules(found, rules, _matchable(found), f"{name}_hit")
    return found.select(
        "user_agent",
        F.col("crawler.botid").cast("bigint").alias("crawler_id"),
        F.col("client_hit.id").alias("client_id"),
        F.col("client_hit.version").alias("version"),
        F.col("os_hit.id").alias("os_id"),
        F.col("device_hit.id").alias("device_id"),
    )


def describe_identified(df: DataFrame, identified: Lookup, signatures: Signatures) -> DataFrame:
    """Add ``ua`` from a lookup of agents to ``AGENT_IDS``; only numbers travel with the rows."""
    ids = F.struct(*(f.split()[0] for f in AGENT_IDS.split(", "))).alias("__ids")
    numbered = Lookup(identified.table.select(F.col(identified.key).alias("__agent"), ids), "__agent", identified.small)
    found = lookup_join(df, numbered, F.col("user_agent"))
    found = attach(found, signatures.crawlers_by_id(), F.col("__ids.crawler_id"), "crawler")
    for rules, name in (
        (signatures.clients, "client"), (signatures.systems, "os"), (signatures.devices, "device")
    ):
        found = attach(found, rules.described, F.col(f"__ids.{name}_id"), name)
    version = F.struct(F.col("__ids.version").alias("version")).alias("client_hit")
    return _described(found.select("*", version), df.columns)


def classify_ip(df: DataFrame, signatures: Signatures) -> DataFrame:
    """Add ``address`` (ip, ip_ver, ip_classification_code) of ``ip``.

    Only IPv4 addresses are looked up, by their text.
    """
    kept = df.columns
    version = F.when(ip_version(F.col("ip")) == "v4", "v4").otherwise("")
    known = df.withColumn("__version", version)
    looked_up = attach(
        known, signatures.addresses, F.when(F.col("__version") == "v4", F.col("ip")), "listed"
    )
    return looked_up.select(
        *kept,
        F.struct(
            F.col("ip"),
            F.col("__version").alias("ip_ver"),
            F.coalesce("listed.ip_classification_code", F.lit("")).alias("ip_classification_code"),
        ).alias("address"),
    )


def _inline(signatures: Signatures) -> bool:
    rules = (signatures.clients, signatures.systems, signatures.devices)
    if any(r.patterns is None for r in rules):
        return False
    return sum(len(r.patterns) for r in rules) <= INLINE_PATTERNS


def parse_user_agents(
    df: DataFrame, signatures: Signatures, strategy: str = "auto", agents: AgentDictionary | None = None
) -> DataFrame:
    """Add ``ua`` and ``address`` to rows with ``user_agent`` and ``ip``.

    ``strategy`` is ``inline`` (try the patterns on each row), ``distinct``
    (identify each distinct agent once and join the numbers back) or ``auto``, which
    goes by the number of patterns. With a dictionary only agents that it does not know
    yet are identified. ``df`` is then read twice, so it is written once before.
    """
    if strategy == "auto":
        # A stream cannot be scanned twice; its batches can, see the streaming plans.
        strategy = "inline" if df.isStreaming or (agents is None and _inline(signatures)) else "distinct"
    if strategy == "inline":
        described = describe_user_agents(df, signatures)
    elif strategy == "distinct":
        df = materialize(df, "rows")
        if agents is None:
            distinct = materialize(df.select("user_agent").distinct(), "agents")
            known = materialize(identify_agents(distinct, signatures), "identified")
        else:
            agents.add(df)
            known = agents.known()
        described = describe_identified(df, Lookup.measure(known, "user_agent"), signatures)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return classify_ip(described, signatures)
