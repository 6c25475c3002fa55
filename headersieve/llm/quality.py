"""Quality of whole texts by weak supervision, with DataFrame functions only.

Each text gets measures (words, symbols, repeated lines and windows, capitals, ...). Rules over
the measures vote good, bad or abstain; expectation-maximisation over the counts of distinct vote
patterns estimates how far each rule can be trusted, and a text is kept if its posterior
probability of being good is at least ``KEEP_FROM``. Only two hard limits stand beside it
(``base_failed``): fewer than ``LEAST_WORDS`` words, or over 20 % of the words inside repeated
windows.

Null texts have no words and fail the base, as empty ones do. A text is measured by itself, so ties
and repeated rows get equal verdicts; an empty table gives an empty result. Memory for a text grows
with its length: windows are numbers, sorted within the row, and only where one repeats. Windows
are compared by a 64-bit hash of their words. Existing columns of a result's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headersieve.llm.texts import NOT_SPACE, SPACE_RUN, words_of
from headersieve.llm.weak_supervision import VoteModel, fit_votes
from headersieve.session import fresh_path, materialize

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
SYMBOLS = "#*$%&|<>"
KEEP_FROM = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = (*BASE, "n_lines", "n_lettered", "n_upper", "n_letters", "n_stops", "n_distinct_words")


def _count_chars(text: Column, others: str) -> Column:
    """Characters that are left once runs of ``others`` are gone."""
    return F.length(F.regexp_replace(text, others, "")).cast("bigint")


def measure_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of each text, as ``bigint`` columns."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(NOT_SPACE))
    step = docs.withColumns({"_qr_words": words_of(F.col(text)), "_qr_lines": lines})
    n_words, words = F.size("_qr_words"), F.col("_qr_words")
    step = step.withColumn("_qr_hashes", F.transform(words, lambda w: F.xxhash64(w)))
    hashes = F.col("_qr_hashes")
    windows = F.transform(
        F.sequence(F.lit(0), n_words - WINDOW),
        lambda at: F.xxhash64(*[F.get(hashes, at + k) for k in range(WINDOW)]),
    )
    step = step.withColumn("_qr_windows", F.when(n_words > WINDOW, windows))
    windows = F.col("_qr_windows")
    paired = F.transform(windows, lambda h, at: F.struct(h.alias("h"), at.alias("at")))
    # Most texts repeat no window; only the others are sorted.
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    step = step.withColumn("_qr_sorted", F.when(repeats, F.sort_array(paired)))
    order = F.col("_qr_sorted")

    def again(item: Column, at: Column) -> Column:
        before = F.when(at > 0, F.get(order, at - 1)["h"])
        return F.coalesce(item["h"] == before, F.lit(False)) | F.coalesce(
            item["h"] == F.get(order, at + 1)["h"], F.lit(False)
        )

    starts = F.sort_array(F.transform(F.filter(order, again), lambda item: item["at"]))
    step = step.withColumn("_qr_starts", starts)
    starts = F.col("_qr_starts")
    covered = F.aggregate(
        F.transform(
            starts,
            lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - at, F.lit(WINDOW))),
        ),
        F.lit(0),
        lambda total, more: total + more,
    )
    return step.withColumns(
        {
            "n_words": n_words.cast("bigint"),
            "word_chars": _count_chars(whole, SPACE_RUN),
            "n_symbols": _count_chars(whole, f"[^{SYMBOLS}]+"),
            "n_dup_lines": (F.size("_qr_lines") - F.size(F.array_distinct("_qr_lines"))).cast("bigint"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
            "n_lines": F.size("_qr_lines").cast("bigint"),
            "n_lettered": F.regexp_count(whole, F.lit(rf"\p{{L}}{NOT_SPACE}*+")).cast("bigint"),
            "n_upper": _count_chars(whole, r"[^\p{Lu}]+"),
            "n_letters": _count_chars(whole, r"[^\p{L}]+"),
            "n_stops": _count_chars(whole, "[^.!?。]+"),
            "n_distinct_words": F.size(F.array_distinct(hashes)).cast("bigint"),
        }
    ).drop("_qr_words", "_qr_lines", "_qr_hashes", "_qr_windows", "_qr_sorted", "_qr_starts")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("tinyint")


def rule_votes() -> dict[str, Column]:
    """The rules, over the columns of ``measure_texts``."""
    words, letters, lines = F.col("n_words"), F.col("n_letters"), F.col("n_lines")
    chars, symbols, upper = F.col("word_chars"), F.col("n_symbols"), F.col("n_upper")
    repeated, stops, distinct = F.col("n_repeat_words"), F.col("n_stops"), F.col("n_distinct_words")
    return {
        "v_length": _vote(words >= 30, words < 8),
        "v_word_length": _vote(chars.between(3 * words, 9 * words), (chars < 2 * words) | (chars > 15 * words)),
        "v_symbols": _vote(100 * symbols <= 2 * words, 100 * symbols > 10 * words),
        "v_lines": _vote((lines > 1) & (F.col("n_dup_lines") == 0), 100 * F.col("n_dup_lines") > 30 * lines),
        "v_repeats": _vote(100 * repeated <= 2 * words, 100 * repeated > 10 * words),
        "v_capitals": _vote((letters > 0) & (100 * upper <= 15 * letters), 100 * upper > 30 * letters),
        "v_letters": _vote(100 * letters >= 85 * chars, 100 * letters < 70 * chars),
        "v_lettered": _vote(100 * F.col("n_lettered") >= 85 * words, 100 * F.col("n_lettered") < 70 * words),
        "v_sentences": _vote((stops > 0) & words.between(2 * stops, 60 * stops), (words >= 30) & (words > 150 * stops)),
        "v_variety": _vote(
            (words >= 20) & (words <= 1000) & (100 * distinct >= 35 * words),
            (words >= 20) & (words <= 1000) & (100 * distinct < 20 * words),
        ),
    }


RULES = (
    "v_length",
    "v_word_length",
    "v_symbols",
    "v_lines",
    "v_repeats",
    "v_capitals",
    "v_letters",
    "v_lettered",
    "v_sentences",
    "v_variety",
)


def base_failed() -> Column:
    words, repeated = F.col("n_words"), F.col("n_repeat_words")
    return (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * words)


def fit_quality(voted: DataFrame) -> VoteModel:
    """The trust in each rule, from all rows of ``voted`` (measures and votes) that pass the base.

    What fails the base is rejected anyway, and its one kind of fault would drown the others.
    """
    patterns = voted.where(~base_failed()).groupBy(*RULES).agg(F.count("*").alias("n"))
    # At most 3^10 rows; written once, since each round of the fit reads them.
    return fit_votes(materialize(patterns, "votes").coalesce(1), RULES)


def judge(voted: DataFrame, model: VoteModel) -> DataFrame:
    """``voted`` with ``quality`` (posterior), ``base_failed`` and ``kept``; the votes are dropped."""
    quality = model.posterior([F.col(rule) for rule in RULES])
    return (
        voted.withColumns({"quality": quality, "base_failed": base_failed()})
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))
        .drop(*RULES)
    )


def measured_votes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of each text and the votes on it."""
    return measure_texts(docs, text).withColumns(rule_votes())


def rate_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the measures, ``quality``, ``base_failed`` and ``kept``.

    The texts are read once: measures and votes are written to the shared folder, and the fit and
    the verdicts read those.
    """
    voted = materialize(measured_votes(docs, text).drop(text), "quality")
    return judge(voted, fit_quality(voted))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a kept text, columns unchanged."""
    columns = [F.col(f"_in.{name}").alias(name) for name in docs.columns]
    inside = docs.select(F.struct(*[F.col(name) for name in docs.columns]).alias("_in"), F.col(text).alias("_text"))
    voted = measured_votes(inside, "_text").drop("_text", *set(MEASURES) - {"n_words", "n_repeat_words"})
    path = fresh_path(docs.sparkSession, "quality")
    voted.write.option("compression", "zstd").parquet(path)
    voted = docs.sparkSession.read.parquet(path)
    return judge(voted, fit_quality(voted)).where("kept").select(*columns)
