"""Toxicity of whole texts by a weighted finite-state pattern grammar.

Words are read by small transducers: insults, threats (a violent verb that reaches a target), targets
(you, they, ...), negation and reported speech. Their composition runs over each clause; what it gives
out is not single words but hits with a state: targeted or not, negated or not, reported or not. A
hit weighs the smaller of two log-odds, of its term and of its state, so a negated or quoted insult
counts for less, as far as the labels say so. A clause sums its hits, up to ``MOST_OF_CLAUSE``; the
score of a text is the logistic of ``BIAS`` plus the sum over its clauses.

The insult transducer starts from a short list of words and is completed from labelled rows: words, and
stems of four to seven letters with at least three words, that toxic texts have far more often
(log-likelihood ratio and odds). What is counted is not occurrences but different neighbourhoods
(word before, word after), since a copied text says nothing new. The fit uses about ``SAMPLE_TEXTS``
whole labelled texts of either class, drawn by a hash of the id; scoring uses the text alone.

Null and empty texts have no clause and get the lowest score. Labels that are null or not 0 or 1 teach
nothing; of repeated labels the highest counts. Rows are independent: repeats get equal scores, empty
tables give an empty result, and without labels the short list decides. Columns of a result's name
are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headersieve.llm.texts import bound_batches
from headersieve.session import materialize

SAMPLE_TEXTS = 6000
THRESHOLD = 0.7
BIAS = -3.0
MOST_OF_TERM, MOST_OF_CLAUSE = 5.0, 8.0
#: A term is learnt if its log-likelihood ratio and its odds reach these.
LEAST_RATIO, LEAST_ODDS = 30.0, 10.0
STEM_LENGTHS = range(4, 8)
STEM_WORDS = 3
#: How many hits the prior log-odds of a state count as.
BELIEF = 5.0

INSULTS = (
    "idiot idiots moron morons stupid imbecile dumbass loser losers worthless pathetic scum trash clown "
    "disgusting filthy vermin dummkopf vollidiot arschloch abschaum connard imbécile crétin ordure "
    "estúpido imbécil basura escoria"
).split()
VIOLENCE = (
    "kill hurt destroy beat burn shoot stab hang strangle töten umbringen verprügeln tuer frapper matar golpear".split()
)
TARGETS = (
    "you your you're u ya they them those these du dich dir ihr euch sie tu toi te vous vos eux usted tú ti ustedes"
).split()
NEGATION = "not no never isn't aren't nobody nicht kein keine nie ne pas jamais nunca tampoco".split()
REPORTING = (
    "said says say called calls claimed wrote quoted according alleged sagte nannte laut dit appelé selon dijo llamó según"
).split()

_TOKEN = re.compile(r"\w+(?:['’]\w+)*")
_CLAUSE = re.compile(r"[^.!?;\n]+")
#: How many words a negation or a target reaches.
NEGATION_REACH, TARGET_REACH = 3, 4

TARGETED, NEGATED, REPORTED = 1, 2, 4
#: What is believed of a hit in each state before the labels are seen, in log-odds.
_PRIOR = {s: 5.0 - 3.0 * bool(s & NEGATED) - 2.5 * bool(s & REPORTED) + 0.5 * bool(s & TARGETED) for s in range(8)}


@dataclass(frozen=True)
class Grammar:
    """Weights of insulting words and stems, and log-odds of the states of a hit."""

    words: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    states: dict[int, float] = field(default_factory=lambda: dict(_PRIOR))

    def insult(self, word: str) -> float:
        """What the insult transducer gives out for a word; 0 if it doesn't accept it."""
        best = self.words.get(word, 0.0)
        if self.stems and word not in self.words:
            for n in STEM_LENGTHS:
                if len(word) >= n:
                    best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def hits(self, clause: list[str]) -> Iterator[tuple[float, int]]:
        """Weight and state of each hit of the composed transducers in a clause."""
        denied = aimed = -1  # up to where the last negation and the last target reach
        told = False
        for at, word in enumerate(clause):
            if word in _NEGATION:
                denied = at + NEGATION_REACH
            elif word in _TARGETS:
                aimed = at + TARGET_REACH
            elif word in _REPORTING:
                told = True
            ahead = clause[at + 1 : at + 1 + TARGET_REACH]
            weight = self.insult(word)
            if word in _VIOLENCE and any(w in _TARGETS for w in ahead[:2]):
                weight = MOST_OF_TERM
            if weight > 0:
                targeted = aimed >= at or any(w in _TARGETS for w in ahead)
                yield weight, TARGETED * targeted + NEGATED * (denied >= at) + REPORTED * told

    def text_hits(self, text: str) -> Iterator[list[tuple[float, int]]]:
        """The hits of each clause that has some."""
        lowered = text.lower()
        words = set(_TOKEN.findall(lowered))
        if not any(w in self.words or w in _VIOLENCE or self.insult(w) for w in words):
            return
        for clause in _CLAUSE.finditer(lowered):
            if hits := list(self.hits(_TOKEN.findall(clause[0]))):
                yield hits

    def score(self, text: str | None) -> float:
        total = BIAS
        for hits in self.text_hits(text or ""):
            total += min(MOST_OF_CLAUSE, sum(max(0.1, min(weight, self.states[state])) for weight, state in hits))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, total))))


_NEGATION, _TARGETS = frozenset(NEGATION), frozenset(TARGETS)
_REPORTING, _VIOLENCE = frozenset(REPORTING), frozenset(VIOLENCE)


def neighbourhoods(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``toxic, word, around`` of labelled texts, each once per text."""
    for batch in batches:
        for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
            words = _TOKEN.findall((text or "").lower())
            if not words:
                continue
            around = zip(["", *words], words, [*words[1:], ""], strict=False)
            rows = {(word, f"{before} {after}") for before, word, after in around}
            yield pd.DataFrame(rows, columns=["word", "around"]).assign(toxic=toxic)[["toxic", "word", "around"]]


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``toxic, text`` of about ``SAMPLE_TEXTS`` rows of either label."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    counts = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000))
    chosen = F.lit(False)
    for toxic, n in sorted(counts.items()):
        chosen = chosen | ((F.col("toxic") == toxic) & (drawn < math.ceil(1_000_000 * SAMPLE_TEXTS / n)))
    # Some 12,000 ids, whatever the size of the tables: small enough for every task.
    ids = F.broadcast(known.where(chosen))
    return docs.select(key, F.col(text).alias("text")).join(ids, key).select("toxic", "text")


def fit_grammar(sample: DataFrame) -> Grammar:
    """The grammar with the terms and states that a sample (``toxic, text``) teaches."""
    sample = materialize(sample, "labelled")
    bound_batches(sample.sparkSession)
    around = sample.mapInPandas(neighbourhoods, "toxic int, word string, around string").distinct()
    words = materialize(
        around.groupBy("word").agg(
            F.sum("toxic").cast("double").alias("bad"), F.sum(1 - F.col("toxic")).cast("double").alias("good")
        ),
        "words",
    )
    total = words.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    if not total or not total["bad"] or not total["good"]:
        return Grammar({word: MOST_OF_TERM for word in INSULTS})
    share = total["bad"] / (total["bad"] + total["good"])
    prior_odds = total["bad"] / total["good"]

    lengths = F.filter(F.array(*[F.lit(n) for n in STEM_LENGTHS]), lambda n: n < F.length("word"))
    stems = (
        words.select(F.explode(lengths).alias("n"), "word", "bad", "good")
        .groupBy(F.expr("left(word, n)").alias("word"))
        # A stem has to stand without its most frequent word, which is learnt as a word.
        .agg(
            (F.sum("bad") - F.max("bad")).alias("bad"),
            F.sum("good").alias("good"),
            F.count("*").alias("kinds"),
        )
        .where(F.col("kinds") >= STEM_WORDS)
    )
    every = words.withColumn("kinds", F.lit(0).cast("bigint")).unionByName(stems.select("word", "bad", "good", "kinds"))
    n, p = F.col("bad") + F.col("good"), F.col("bad") / (F.col("bad") + F.col("good"))
    ratio = 2 * (
        F.when(F.col("bad") > 0, F.col("bad") * F.log(p / share)).otherwise(0.0)
        + F.when(F.col("good") > 0, F.col("good") * F.log((1 - p) / (1 - share))).otherwise(0.0)
    )
    odds = (F.col("bad") + 0.5) / (F.col("good") + 0.5) / prior_odds
    learnt = every.where((n > 0) & (p > share) & (ratio >= LEAST_RATIO) & (odds >= LEAST_ODDS))
    terms: dict[str, float] = {}
    known = words.where(F.col("word").isin(*INSULTS)).select("word", "bad", "good").collect()
    seen = {row["word"]: (row["bad"], row["good"]) for row in known}
    for word in INSULTS:
        bad, good = seen.get(word, (0.0, 0.0))
        weight = math.log((bad / prior_odds + 4.0) / (good + 0.03))
        if weight > 0:
            terms[word] = round(min(MOST_OF_TERM, weight), 4)
    found: dict[str, float] = {}
    # At most as many as the sample has neighbourhoods by a few: each term needs several of its own.
    rows = learnt.select("word", "kinds", "bad", F.log(odds).alias("weight")).collect()
    weighed = {row["word"]: row["bad"] for row in rows if row["kinds"]}
    for row in rows:
        # A stem gives way to a longer one that says as much and is true of fewer words.
        longer = (weighed.get(s, 0.0) for s in weighed if len(s) > len(row["word"]) and s.startswith(row["word"]))
        if row["kinds"] and max(longer, default=0.0) >= 0.95 * row["bad"]:
            continue
        into = found if row["kinds"] else terms
        into[row["word"]] = round(max(into.get(row["word"], 0.0), min(MOST_OF_TERM, row["weight"])), 4)
    grammar = Grammar(terms, found)

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (state, toxic)
                for toxic, text in zip(batch["toxic"], batch["text"], strict=True)
                for hits in grammar.text_hits(text or "")
                for _, state in hits
            ]
            yield pd.DataFrame(rows, columns=["state", "toxic"]).astype("int32")

    counted = sample.mapInPandas(states, "state int, toxic int").groupBy("state")
    weights = dict(_PRIOR)
    for row in counted.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).collect():
        believed = 1 / (1 + math.exp(-_PRIOR[row["state"]]))
        odds_there = (row["bad"] / prior_odds + BELIEF * believed) / (row["good"] + BELIEF * (1 - believed))
        weights[row["state"]] = round(math.log(odds_there), 4)
    return Grammar(terms, found, weights)


def score_toxicity(docs: DataFrame, grammar: Grammar, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    bound_batches(docs.sparkSession)

    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([grammar.score(text) for text in texts.tolist()], dtype="float64")

    return docs.withColumn("score", F.pandas_udf(scored, "double")(F.col(text))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
