"""An index of the texts that ordered patterns cannot match without.

A pattern is kept under a run of letters that every match of it must hold, one run for each of its top-level
alternatives, or for each of those of a group that has to match. A text meets only the patterns whose runs it holds,
by way of the rarest part of a run: 24, 12, 6 or 3 characters, as many as the run has, so that runs which differ
in a few characters are told apart however many there are. The patterns found are then tried as regular
expressions, and the first in order stays. Of rules with the same pattern only the first can win; the others are
left out. Patterns without such a run are tried on every text.

What is taken for a required run errs on the safe side: escapes, classes, optional or repeated parts and groups
with alternatives end a run, and a pattern with syntax that could change what letters mean (hexadecimal and
property escapes, quoting, back references, free spacing, Unicode case folding) has none.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headersieve.functions.headers import once
from headersieve.operators.lookup import fits_broadcast, in_hash_bits
from headersieve.session import materialize

GRAM = 3
# Lengths of the parts under which runs are kept; a run takes the greatest that it has.
GRAMS = (3, 6, 12, 24)
# Bits of the table that tells parts of texts outside an index that does not fit a broadcast.
INDEX_BITS = 26
# Groups in groups up to this depth are looked into; deeper ones leave the pattern without a run.
GROUP_DEPTH = 8
# Patterns without a run that are tried in one expression.
REST_BLOCK = 500

_CUT, _GROUP, _OR = "\x00", "\x01", "\x02"
_UNSAFE = r"\\[xuUpPNckQ0-9G]|\(\?[a-zA-Z-]*[xuU]|\x00"
_ORDER = ("sequence", "id", "pattern")


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone, as patterns without Unicode case folding see it."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _longest_run(branch: Column) -> Column:
    """The longest run of letters that an alternative, without groups and classes, requires."""
    bare = F.regexp_replace(branch, r"(?s).(?:[?*]|\{[^}]*\})[?+]?", _CUT)
    bare = F.regexp_replace(bare, r"(?s)(.)\+[?+]?", f"$1{_CUT}")
    bare = F.regexp_replace(bare, r"[.^$]", _CUT)
    runs = F.transform(F.split(bare, _CUT), lambda run: F.struct(F.length(run).alias("n"), run.alias("text")))
    return F.array_max(runs)["text"]


def required_runs(pattern: Column) -> Column:
    """One required run in lower case for each alternative of a pattern; null if an alternative has none."""
    bare = F.regexp_replace(pattern, r"(?s)\\.", _CUT)
    bare = F.regexp_replace(bare, r"\[\^?\]?[^\]\[]*\]", _CUT)
    for _ in range(GROUP_DEPTH):
        # A group that has to match once adds its letters to the run around it.
        bare = F.regexp_replace(bare, r"\((?:\?:)?([^()|?][^()|]*)\)(?![?*{])", "$1")
        bare = F.regexp_replace(bare, r"\([^()]*\)", _CUT)
    runs = F.transform(F.split(bare, r"\|"), lambda branch: ascii_lower(_longest_run(branch)))
    usable = ~pattern.rlike(_UNSAFE) & ~bare.rlike(r"[\[()]") & F.forall(runs, lambda run: F.length(run) >= GRAM)
    return F.when(usable, runs)


def _best_of_branch(branch: Column) -> Column:
    """The runs of the part of an alternative whose shortest run is longest: a text between groups, or a group."""

    def runs_of(part: Column, k: Column) -> Column:
        between = F.array(_longest_run(F.regexp_replace(part, r"\A\+[?+]?", _CUT)))
        return F.when(k % 2 == 0, between).otherwise(F.transform(F.split(part, _OR), _longest_run))

    def rated(runs: Column) -> Column:
        return F.struct(F.array_min(F.transform(runs, F.length)).alias("least"), (-F.size(runs)).alias("few"), runs.alias("runs"))

    return F.array_max(F.transform(F.transform(F.split(branch, _GROUP), runs_of), rated))["runs"]


def runs_in_groups(pattern: Column) -> Column:
    """Required runs like ``required_runs``, also from the alternatives of a group that has to match; null if there are none."""
    bare = F.regexp_replace(pattern, r"(?s)\\.", _CUT)
    bare = F.regexp_replace(bare, r"\[\^?\]?[^\]\[]*\]", _CUT)
    marked = f"{_GROUP}[^{_GROUP}]*{_GROUP}"
    merged = rf"\((?:\?:)?((?:[^()|?{_GROUP}{_OR}]|{marked})(?:[^()|{_GROUP}{_OR}]|{marked})*)\)(?![?*{{])"
    for _ in range(GROUP_DEPTH):
        bare = F.regexp_replace(bare, merged, "$1")
        # The alternatives of an innermost group stay between two marks; a group that has such marks among its alternatives is given up.
        bare = F.regexp_replace(bare, r"\|(?=[^()]*\))", _OR)
        bare = F.regexp_replace(bare, rf"\((?:\?:)?([^()?{_GROUP}{_OR}][^(){_GROUP}]*)\)(?![?*{{])", f"{_GROUP}$1{_GROUP}")
        bare = F.regexp_replace(bare, merged, "$1")
        bare = F.regexp_replace(bare, r"\([^()]*\)", _CUT)
    runs = F.flatten(F.transform(F.split(bare, r"\|"), _best_of_branch))
    runs = F.transform(runs, ascii_lower)
    usable = ~pattern.rlike(f"{_UNSAFE}|[{_GROUP}{_OR}]") & ~bare.rlike(r"[\[()]") & F.forall(runs, lambda run: F.length(run) >= GRAM)
    return F.when(usable, runs)


def grams_of(text: Column, size: int | Column = GRAM) -> Column:
    """The different runs of ``size`` characters of a text."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    empty = F.array().cast("array<string>")
    return F.coalesce(F.array_distinct(F.transform(places, lambda at: F.substr(text, at, size))), empty)


@dataclass(frozen=True)
class PatternIndex:
    """Patterns by the gram under which a text finds them, and those to be tried on every text.

    ``keyed`` has a row ``(gram, run)`` for each different required run, ``sizes`` the lengths of its grams, and ``ruled``
    a row ``(run, sequence, id, pattern)`` for each run of a pattern; ``small`` and ``ruled_small`` tell whether they
    were measured to fit a broadcast. ``rest`` has ``(sequence, id, pattern)``.
    """

    keyed: DataFrame
    small: bool
    rest: DataFrame
    ruled: DataFrame
    ruled_small: bool
    sizes: tuple[int, ...]

    @staticmethod
    def build(ordered: DataFrame) -> PatternIndex:
        """Index the readable patterns ``(sequence, id, pattern)``."""
        first = ordered.groupBy("pattern").agg(F.min(F.struct("sequence", "id")).alias("rule"))
        found = F.coalesce(required_runs(F.col("pattern")), runs_in_groups(F.col("pattern")))
        runs = materialize(first.select("rule.sequence", "rule.id", "pattern", found.alias("runs")), "patterns")
        known = runs.filter(F.col("runs").isNotNull())
        ruled = materialize(known.select(F.explode(F.array_distinct("runs")).alias("run"), *_ORDER), "ruled")
        size = F.greatest(*(F.when(F.length("run") >= n, n) for n in GRAMS))
        grams = ruled.select("run").distinct().withColumn("gram", F.explode(grams_of(F.col("run"), size)))
        # Of a run's grams the one that the fewest runs have says the most.
        counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("runs"))
        rarest = grams.join(counts, "gram").groupBy("run").agg(F.min(F.struct("runs", "gram"))["gram"].alias("gram"))
        keyed = materialize(rarest.select("gram", "run"), "pattern_index")
        sizes = sorted(row["n"] for row in keyed.select(F.length("gram").alias("n")).distinct().collect())
        rest = runs.filter(F.col("runs").isNull()).select(*_ORDER)
        return PatternIndex(keyed, fits_broadcast(keyed), rest, ruled, fits_broadcast(ruled), tuple(sizes))


def _found(text: Column, pattern: Column) -> Column:
    return F.call_function("rlike", text, pattern)


def _first_of_rest(texts: DataFrame, index: PatternIndex, block: int) -> DataFrame:
    """Add ``first``, the first of the patterns without a run that is found in ``text``."""
    none = F.lit(None).cast("struct<sequence:bigint,id:bigint,pattern:string>")
    texts = texts.withColumn("first", none)
    last = None
    while True:
        # The driver holds one block of patterns at a time, in order.
        left = index.rest if last is None else index.rest.filter(F.struct(*_ORDER) > last)
        rows = left.orderBy(*_ORDER).limit(block).collect()
        if not rows:
            return texts
        tries = [
            F.when(
                F.col("text").rlike(row["pattern"]),
                F.struct(
                    F.lit(row["sequence"]).cast("bigint").alias("sequence"),
                    F.lit(row["id"]).cast("bigint").alias("id"),
                    F.lit(row["pattern"]).alias("pattern"),
                ),
            )
            for row in rows
        ]
        texts = texts.withColumn("first", F.coalesce("first", *tries, none))
        if len(rows) < block:
            return texts
        texts = materialize(texts, "rest")
        last = F.struct(*(F.lit(rows[-1][c]).cast(left.schema[c].dataType).alias(c) for c in _ORDER))


def match_texts(texts: DataFrame, index: PatternIndex, block: int = REST_BLOCK) -> DataFrame:
    """``(text, hit)`` for different texts: the first pattern in order as struct (id, version), or null.

    A text is taken apart into its grams, which meet the index by an equality join; the index is broadcast
    if it was measured to fit. If not, a table of bits drops most grams outside the index before any move. Only pairs of
    a text and a pattern whose run it holds are tried.
    """
    # Few texts lie in few files; taking them apart is the work, so they are dealt out first.
    spark = texts.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = texts.select("text").repartition(parts, "text")
    tried = _first_of_rest(texts, index, block)
    lowered = once(texts, "lower", ascii_lower(F.col("text")))
    windows = [grams_of(F.col("lower"), size) for size in index.sizes] or [grams_of(F.col("lower"))]
    grams = lowered.select("text", "lower", F.explode(F.concat(*windows)).alias("gram"))
    if not index.small:
        grams = in_hash_bits(grams, F.col("gram"), index.keyed, F.col("gram"), INDEX_BITS)
    keyed = F.broadcast(index.keyed) if index.small else index.keyed
    pairs = grams.join(keyed, "gram").filter(F.contains("lower", F.col("run"))).select("text", "run")
    ruled = F.broadcast(index.ruled) if index.ruled_small else index.ruled
    found = pairs.join(ruled, "run").filter(_found(F.col("text"), F.col("pattern")))
    order = F.struct(F.col("sequence").cast("bigint").alias("sequence"), F.col("id").cast("bigint").alias("id"), "pattern")
    best = found.groupBy(F.col("text").alias("__text")).agg(F.min(order).alias("keyed"))
    joined = tried.join(best, F.col("text") == F.col("__text"), "left").select("text", F.least("first", "keyed").alias("best"))
    # The empty group makes sure that there is one to take the version from.
    version = F.call_function(
        "regexp_extract", F.col("text"), F.concat(F.col("best.pattern"), F.lit("()")), F.lit(1)
    )
    hit = F.when(F.col("best").isNotNull(), F.struct(F.col("best.id").alias("id"), version.alias("version")))
    return joined.select("text", hit.alias("hit"))
