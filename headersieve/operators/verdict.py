"""Scores, verdicts and how often they are wrong."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headersieve.functions import fixed_values as V
from headersieve.functions.crawlers import is_crawler
from headersieve.functions.headers import once, pick_user_agent, sorted_order
from headersieve.functions.scoring import LinearScorer, human_verdict, sigmoid
from headersieve.operators.features import full_features
from headersieve.operators.lookup import Lookup, lookup_join
from headersieve.operators.match import parse_user_agents
from headersieve.operators.scorer import TableScorer
from headersieve.operators.shred import shred_request_body
from headersieve.sources.signatures import Signatures

if TYPE_CHECKING:
    from headersieve.sources.agents import AgentDictionary


def crawler_flag(words_only: bool = False) -> Column:
    """The crawler test over rows described by ``parse_user_agents``."""
    return is_crawler(
        F.col("user_agent"),
        F.col("ua.ua_class_code"),
        F.col("ua.ua_family_code"),
        F.col("address.ip_classification_code"),
        words_only,
    )


def drop_crawlers(df: DataFrame, words_only: bool = False) -> DataFrame:
    return df.filter(~crawler_flag(words_only))


def score_by_join(df: DataFrame, coefficients: DataFrame, id_column: str = "log_id") -> DataFrame:
    """``(id, class, prob)`` from rows with any number of ``positions`` and a table of weights.

    Column -1 of the table holds the intercepts, so each row gets it as one more set column.
    """
    by_column = coefficients.groupBy("column").agg(
        F.collect_list(F.struct("class", "weight")).alias("weights")
    )
    lookup = Lookup.measure(by_column, "column")
    rows = df.filter(F.size("positions") > 0).select(id_column, F.concat(F.array(F.lit(-1)), "positions").alias("__cells"))
    if lookup.small:
        # Rows move once, before they become cells; the weights come to them, and an id's cells meet where they are.
        rows = rows.repartition(id_column)
    cells = rows.select(id_column, F.explode("__cells").alias("__cell"))
    weighted = lookup_join(cells, lookup, F.col("__cell")).filter(F.col("weights").isNotNull())

    # Doubles are added in the order of columns and then of classes, as in one expression,
    # so that both ways of scoring give the same last digit.
    def terms_of(cell: Column) -> Column:
        return F.transform(
            cell["weights"],
            lambda w: F.struct(w["class"].alias("class"), cell["__cell"].alias("cell"), w["weight"].cast("double").alias("weight")),
        )

    collected = F.collect_list(F.struct("__cell", "weights"))
    terms = weighted.groupBy(id_column).agg(F.sort_array(F.flatten(F.transform(collected, terms_of))).alias("terms"))

    def begins(k: Column) -> Column:
        return (k == 1) | ~F.get("terms", k - 1)["class"].eqNullSafe(F.get("terms", k - 2)["class"])

    starts = terms.withColumn("starts", F.filter(F.sequence(F.lit(1), F.size("terms")), begins))

    def scored(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("terms") + 1)
        margin = F.aggregate(F.slice("terms", start, end - start), F.lit(0.0), lambda acc, t: acc + t["weight"])
        return F.struct(F.get("terms", start - 1)["class"].alias("class"), sigmoid(margin).alias("score"))

    scores = (
        starts.select(id_column, F.transform("starts", scored).alias("scores"))
        .withColumn("total", F.aggregate(F.col("scores.score"), F.lit(0.0), lambda acc, x: acc + x))
        .select(id_column, "total", F.inline("scores"))
    )
    return scores.select(
        id_column,
        "class",
        F.round(F.col("score") / F.col("total"), V.PROBABILITY_DIGITS).alias("prob"),
    )


def score_families(df: DataFrame, scorer: LinearScorer | TableScorer) -> DataFrame:
    """Add ``probs``, the probability of each family; null if no column is set.

    Rows are scored in place: by weights in the expression, or by lookups in a table of weights.
    """
    if isinstance(scorer, TableScorer):
        return scorer.score(df)
    return once(df, "probs", scorer.probabilities(F.col("positions")))


def request_verdict(
    threshold: float = V.HUMAN_THRESHOLD, words_only: bool = False, ip: str = "client_ip"
) -> Column:
    """The verdict of a described and scored request, as a column."""
    nobody = (F.col("user_agent") == "") & (F.coalesce(F.col(ip), F.lit("")) == "")
    unscored = F.col("probs").isNull() & (F.size("positions") > 0)
    human = human_verdict(F.col("probs"), F.col("ua.ua_family_code"), threshold)
    return (
        F.when(nobody, V.VERDICT_UNKNOWN)
        .when(crawler_flag(words_only), V.VERDICT_CRAWLER)
        .when(unscored | F.col("positions").isNull(), V.VERDICT_ERROR)
        .when(human, V.VERDICT_HUMAN)
        .otherwise(V.VERDICT_BOT)
    )


def judge_requests(
    requests: DataFrame,
    signatures: Signatures,
    vocabulary: DataFrame | Lookup,
    scorer: LinearScorer | TableScorer,
    threshold: float = V.HUMAN_THRESHOLD,
    trim: bool = True,
    unknown: str = "slot0",
    words_only: bool = False,
    agents: AgentDictionary | None = None,
) -> DataFrame:
    """``request_id, client_ip, user_agent, ua_family_code, verdict`` per request."""
    shredded = shred_request_body(requests, trim).withColumn(
        "ip", F.coalesce("client_ip", F.lit(""))
    )
    features = full_features(
        shredded.withColumn("log_id", F.col("request_id")), vocabulary, unknown
    )
    # Scored first, so that the header maps are gone before agents are looked up.
    scored = score_families(features, scorer).select(
        "request_id", "client_ip", "ip", "user_agent", "positions", "probs"
    )
    return parse_user_agents(scored, signatures, agents=agents).select(
        "request_id",
        "client_ip",
        "user_agent",
        F.col("ua.ua_family_code").alias("ua_family_code"),
        request_verdict(threshold, words_only).alias("verdict"),
    )


def judge_logs(
    logs: DataFrame,
    vocabulary: DataFrame | Lookup,
    scorer: LinearScorer | TableScorer,
    threshold: float = V.HUMAN_THRESHOLD,
    order: str = "stored",
    unknown: str = "slot0",
) -> DataFrame:
    """Add ``verdict`` to stored logs by the family they claim, for evaluation.

    No crawler test is made, and a log without the canonical user agent header is
    unknown. ``order="sorted"`` scores headers as if they came in alphabetical
    order.
    """
    kept = logs.columns
    if order == "sorted":
        logs = logs.withColumn("order_data", sorted_order(F.col("value_data")))
    scored = score_families(full_features(logs, vocabulary, unknown), scorer)
    unknown_agent = pick_user_agent(F.col("value_data"), "evaluation") == ""
    human = human_verdict(F.col("probs"), F.col("ua_family_code"), threshold)
    verdict = (
        F.when(unknown_agent, V.VERDICT_UNKNOWN)
        .when(human, V.VERDICT_HUMAN)
        .otherwise(V.VERDICT_BOT)
    )
    return scored.select(*kept, verdict.alias("verdict"))


def verdict_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("verdict").agg(F.count(F.lit(1)).alias("requests"))


def error_rates(
    judged_bots: DataFrame, judged_humans: DataFrame, threshold: float = V.HUMAN_THRESHOLD
) -> DataFrame:
    """One row: humans called bot and bots called human, in percent of all rows judged."""
    both = judged_bots.select("verdict", F.lit(True).alias("is_bot")).unionByName(
        judged_humans.select("verdict", F.lit(False).alias("is_bot"))
    )

    def called(word: str, bot: bool) -> Column:
        match = (F.col("verdict") == word) & (F.col("is_bot") == bot)
        return F.sum(F.when(match, 1).otherwise(0))

    counts = both.agg(
        called(V.VERDICT_HUMAN, False).alias("humans_as_human"),
        called(V.VERDICT_BOT, False).alias("humans_as_bot"),
        called(V.VERDICT_HUMAN, True).alias("bots_as_human"),
        called(V.VERDICT_BOT, True).alias("bots_as_bot"),
        F.count(F.lit(1)).alias("judged"),
    )

    def percent(column: str) -> Column:
        return F.round(F.try_divide(F.col(column) * F.lit(100.0), F.col("judged")), 5)

    return counts.select(
        F.lit(threshold).alias("threshold"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns),
        percent("humans_as_bot").alias("error_1"),
        percent("bots_as_human").alias("error_2"),
    )
