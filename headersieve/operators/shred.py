"""From raw log lines and request bodies to header tables.

Lines need the columns ``log_id`` and ``line``; bodies ``request_id``,
``client_ip`` and ``body``. No bad row ever fails a job: it gets a reason.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from headersieve.functions import headers as H
from headersieve.functions.crawlers import is_crawler
from headersieve.functions.headers import once
from headersieve.operators.match import parse_user_agents
from headersieve.sources.signatures import Signatures

if TYPE_CHECKING:
    from headersieve.sources.agents import AgentDictionary

UA_COLUMNS = (
    "ua_family_code",
    "ua_version",
    "ua_class_code",
    "device_class_code",
    "os_family_code",
    "os_code",
)

#: Why a line is rejected, in the order in which the reasons are looked for.
REASONS = (
    "malformed_line",
    "empty_ip",
    "bad_timestamp",
    "outside_time_range",
    "too_few_parts",
    "empty_headers",
    "unquoted_headers",
    "malformed_json",
    "no_user_agent_key",
    "empty_user_agent",
    "crawler",
    "empty_ua_family",
)


def split_log_line(df: DataFrame) -> DataFrame:
    """Add ``epoch_text`` (10 characters), ``ip`` and ``headers`` (all the rest).

    The character after the time is skipped unchecked. A line without a comma
    behind the ip gets nulls.
    """
    rest = F.substr(F.col("line"), F.lit(12))
    parts = F.when(
        F.locate(",", rest) > 0,
        F.struct(
            F.substring("line", 1, 10).alias("epoch_text"),
            F.substring_index(rest, ",", 1).alias("ip"),
            rest.alias("rest"),
        ),
    )
    headers = F.substr(F.col("parts.rest"), F.length("parts.ip") + 2)
    kept = [c for c in df.columns if c != "ip"]
    return once(df, "parts", parts).select(
        *kept, "parts.epoch_text", "parts.ip", headers.alias("headers")
    )


def epoch_of(epoch_text: Column) -> Column:
    """Whole epoch seconds, null unless the text is nothing but an integer."""
    return F.when(epoch_text.rlike(r"\A[+-]?[0-9]+\z"), epoch_text.try_cast("bigint"))


def in_time_range(epoch: Column, start: int | None, finish: int | None) -> Column:
    """Inclusive at both ends; an end that is None is open."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (epoch >= start)
    if finish is not None:
        inside = inside & (epoch <= finish)
    return inside


def filter_time_range(
    df: DataFrame, start: int | None, finish: int | None, column: str = "epoch"
) -> DataFrame:
    return df.filter(in_time_range(F.col(column), start, finish))


def _line_reason(start: int | None, finish: int | None) -> Column:
    """Why the line itself is unusable, before its headers are looked at."""
    return (
        F.when(F.col("headers").isNull(), "malformed_line")
        .when(F.col("ip") == "", "empty_ip")
        .when(F.col("epoch").isNull(), "bad_timestamp")
        .when(~in_time_range(F.col("epoch"), start, finish), "outside_time_range")
        .when(F.substring_index("line", ",", 2) == F.col("line"), "too_few_parts")
        .when(F.col("headers") == "", "empty_headers")
        .when(~F.col("headers").startswith("'"), "unquoted_headers")
    )


def shred_headers_json(df: DataFrame, json: str = "header_json") -> DataFrame:
    """Add ``value_data`` and ``order_data``, the header maps of a JSON column.

    Both are null if the text is not a JSON object.
    """
    text, headers = F.col(json), F.col("__headers")
    mapped = once(df, "__headers", H.json_map(text))
    return mapped.withColumns(
        {
            "value_data": H.json_values(headers, text),
            "order_data": H.json_positions(headers, text),
        }
    ).drop("__headers")


def header_entries(df: DataFrame, json: str = "header_json") -> DataFrame:
    """Add ``entries``, the header table of a JSON column as an array in order."""
    mapped = once(df, "__headers", H.json_map(F.col(json)))
    listed = once(mapped, "__entries", H.json_entries(F.col("__headers")))
    entries = H.last_entry_per_header(F.col("__entries"))
    return listed.withColumn("entries", entries).drop("__headers", "__entries")


def _shredded_lines(
    df: DataFrame, start: int | None, finish: int | None, ua_mode: str, keep_rejected: bool
) -> DataFrame:
    """Lines with header maps, ``user_agent`` and the ``reason`` known so far.

    Without ``keep_rejected`` lines are dropped as soon as they are unusable,
    which is before JSON is parsed.
    """
    lines = split_log_line(df).withColumn("epoch", epoch_of(F.col("epoch_text")))
    if keep_rejected:
        lines = lines.withColumn("reason", _line_reason(start, finish))
    else:
        lines = lines.filter(_line_reason(start, finish).isNull())
        lines = lines.withColumn("reason", F.lit(None).cast("string"))
    readable = F.when(F.col("reason").isNull(), H.clean_header_json(F.col("headers")))
    shredded = shred_headers_json(lines.withColumn("header_json", readable))
    shredded = once(
        shredded,
        "agent",
        F.struct(
            H.has_user_agent_key(F.col("value_data")).alias("present"),
            H.pick_user_agent(F.col("value_data"), ua_mode).alias("text"),
        ),
    )
    header_reason = (
        F.when(F.col("value_data").isNull(), "malformed_json")
        .when(~F.col("agent.present"), "no_user_agent_key")
        .when(F.col("agent.text") == "", "empty_user_agent")
    )
    shredded = shredded.withColumns(
        {"user_agent": F.col("agent.text"), "reason": F.coalesce("reason", header_reason)}
    )
    if not keep_rejected:
        shredded = shredded.filter(F.col("reason").isNull())
    return shredded.drop("agent", "epoch_text", "headers", "header_json")


def _add_late_reasons(
    shredded: DataFrame,
    signatures: Signatures,
    filter_crawlers: bool,
    need_ua: bool,
    words_only: bool,
    agents: AgentDictionary | None,
) -> DataFrame:
    if not (need_ua or (filter_crawlers and not words_only)):
        parsed, crawler = shredded, is_crawler(F.col("user_agent"), words_only=True)
    else:
        parsed = parse_user_agents(shredded, signatures, agents=agents)
        crawler = is_crawler(
            F.col("user_agent"),
            F.col("ua.ua_class_code"),
            F.col("ua.ua_family_code"),
            F.col("address.ip_classification_code"),
            words_only,
        )
    late = F.when(F.lit(filter_crawlers) & crawler, "crawler")
    if need_ua:
        late = late.when(F.col("ua.ua_family_code") == "", "empty_ua_family")
    return parsed.withColumn("reason", F.coalesce("reason", late))


def reject_reason(
    df: DataFrame,
    signatures: Signatures,
    filter_crawlers: bool = True,
    need_ua: bool = True,
    start: int | None = None,
    finish: int | None = None,
    legacy_ua_pick: bool = False,
    words_only: bool = False,
    agents: AgentDictionary | None = None,
) -> DataFrame:
    """Every line with the first ``reason`` to reject it, null if it is accepted."""
    shredded = _shredded_lines(df, start, finish, "legacy" if legacy_ua_pick else "online", True)
    return _add_late_reasons(shredded, signatures, filter_crawlers, need_ua, words_only, agents)


def parse_log_lines(
    df: DataFrame,
    signatures: Signatures,
    filter_crawlers: bool = True,
    need_ua: bool = True,
    start: int | None = None,
    finish: int | None = None,
    legacy_ua_pick: bool = False,
    words_only: bool = False,
    agents: AgentDictionary | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Accepted lines as ``log_id, epoch, ip, user_agent, [agent columns], maps``.

    With a dictionary in ``agents`` only agents that it does not know yet are tried on the patterns. An
    ``observation`` gets the number of lines ``read``, ``accepted`` and rejected for each reason, from the job that
    uses the lines; tasks that run twice may be counted twice.
    """
    mode, counted = "legacy" if legacy_ua_pick else "online", observation is not None
    shredded = _shredded_lines(df, start, finish, mode, keep_rejected=counted)
    shredded = shredded.select(
        "log_id", "epoch", "ip", "user_agent", "value_data", "order_data", "reason"
    )
    judged = _add_late_reasons(shredded, signatures, filter_crawlers, need_ua, words_only, agents)
    if observation is not None:
        reason = F.col("reason")
        judged = judged.observe(
            observation,
            F.count(F.lit(1)).alias("read"),
            F.count_if(reason.isNull()).alias("accepted"),
            *(F.coalesce(F.count_if(reason == name), F.lit(0)).alias(name) for name in REASONS),
        )
    accepted = judged.filter(F.col("reason").isNull())
    agent = []
    if need_ua:
        family = F.col("ua.ua_family_code")
        full_version = F.concat(family, F.lit(" "), F.col("ua.ua_version")).alias("ua_version")
        agent = [
            full_version if name == "ua_version" else F.col(f"ua.{name}").alias(name)
            for name in UA_COLUMNS
        ]
    return accepted.select(
        "log_id", "epoch", "ip", "user_agent", *agent, "value_data", "order_data"
    )


def raw_headers_with_crawlers(
    df: DataFrame, start: int | None = None, finish: int | None = None
) -> DataFrame:
    """Cleaned header JSON of usable lines, crawlers included, not shredded."""
    lines = split_log_line(df).withColumn("epoch", epoch_of(F.col("epoch_text")))
    usable = lines.filter(_line_reason(start, finish).isNull())
    cleaned = usable.withColumn("header_json", H.clean_header_json(F.col("headers")))
    return cleaned.filter(F.col("header_json") != "").drop("epoch_text", "headers")


def shred_request_body(df: DataFrame, trim: bool = True) -> DataFrame:
    """Requests with ``entries``, header maps and ``user_agent``; empty bodies dropped."""
    filled = df.filter(F.col("body") != "")
    listed = once(filled, "__entries", H.body_entries(F.col("body"), trim))
    entries = H.last_entry_per_header(F.col("__entries"))
    shredded = once(listed, "entries", entries).drop("__entries").withColumns(
        {
            "value_data": H.value_map(F.col("entries")),
            "order_data": H.order_map(F.col("entries")),
        }
    )
    return shredded.withColumn("user_agent", H.pick_user_agent(F.col("value_data")))


def project_logs(parsed: DataFrame) -> DataFrame:
    """Parsed lines in the shape of the ``logs`` table; a missing text is ``""``."""
    texts = {
        name: F.coalesce(F.col(name), F.lit("")) if name in parsed.columns else F.lit("")
        for name in ("ip", "user_agent", *UA_COLUMNS)
    }
    return parsed.select(
        "log_id",
        F.timestamp_seconds("epoch").alias("timestamp"),
        *(text.alias(name) for name, text in texts.items()),
        "value_data",
        "order_data",
    )
