"""Predicates that give a crawler away."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from headersieve.functions.fixed_values import BOT_FAMILIES, CRAWLER_CLASS, CRAWLER_WORDS


def is_bot_family(family_code: Column) -> Column:
    return family_code.isin(*BOT_FAMILIES)


def ua_has_crawler_word(user_agent: Column) -> Column:
    return reduce(lambda a, b: a | b, (user_agent.contains(word) for word in CRAWLER_WORDS))


def is_crawler(
    user_agent: Column,
    ua_class_code: Column | None = None,
    ua_family_code: Column | None = None,
    ip_classification_code: Column | None = None,
    words_only: bool = False,
) -> Column:
    """Crawler by address class, agent class, agent family or a word in the agent.

    ``words_only`` looks at the words alone.
    """
    words = F.coalesce(ua_has_crawler_word(user_agent), F.lit(False))
    if words_only:
        return words
    crawler = CRAWLER_CLASS[1]
    return (
        words
        | F.coalesce(ip_classification_code == crawler, F.lit(False))
        | F.coalesce(ua_class_code == crawler, F.lit(False))
        | F.coalesce(is_bot_family(ua_family_code), F.lit(False))
    )
