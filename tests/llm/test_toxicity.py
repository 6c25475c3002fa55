"""Clauses, states and held-out labels."""

from headersieve.llm.queries import op1_toxicity
from headersieve.llm.toxicity import NEGATED, REPORTED, TARGETED, Grammar, fit_grammar, labelled_sample, score_toxicity

GRAMMAR = Grammar({"idiot": 5.0}, {"lowei": 4.0})


def states(text):
    return [state for hits in GRAMMAR.text_hits(text) for _, state in hits]


def test_states_of_hits():
    assert states("An idiot.") == [0]
    assert states("You are an IDIOT!") == [TARGETED]
    assert states("he is not an idiot") == [NEGATED]
    assert states("not here. an idiot") == [0]
    assert states("she said you idiot") == [TARGETED + REPORTED]
    assert states("I will kill you") == [TARGETED] and states("kill the lights") == []
    assert states("der loweiisch hund") == [0] and states("idiotic lower") == []


def test_scores():
    assert GRAMMAR.score("you idiot") > 0.7 > GRAMMAR.score("he said he is not an idiot") > GRAMMAR.score("")
    assert GRAMMAR.score(None) == GRAMMAR.score("") == GRAMMAR.score("a fine day") < 0.1
    assert GRAMMAR.score("idiot. " * 100_000) <= 1.0


def test_learnt_terms(spark):
    good = [(0, f"the street {i} of w{i * 7} has x{i} windows m{i}") for i in range(300)]
    bad = [(1, f"the street of x{i} blorg{'abcde'[i % 5]} m{i} gnarf windows") for i in range(60)]
    copies = [(1, "some copied text with a quiet lamp")] * 200
    rows = [(i, text, toxic) for i, (toxic, text) in enumerate(good + bad + copies)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    grammar = fit_grammar(labelled_sample(docs.select("doc_id", "text"), docs))
    assert grammar.score("over there gnarf is") > 0.7 and grammar.score("he saw a blorgx today") > 0.7
    assert grammar.score("a quiet lamp copied") < 0.1
    # One toxic word does not make a stem of what it begins with.
    assert grammar.score("he saw gnarly gnarx") < 0.1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "you idiot", "x"), (2, "you idiot", "x")], "doc_id int, text string, score string")
    labels = spark.createDataFrame([(1, None), (2, 7), (None, 1)], "doc_id int, toxic int")
    grammar = fit_grammar(labelled_sample(docs, labels))
    got = score_toxicity(docs, grammar)
    assert sorted(r.predicted for r in got.collect()) == [0, 0, 1, 1]
    assert score_toxicity(docs.limit(0), grammar).count() == 0


def test_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = op1_toxicity(spark, sf_dir)
    rows = [r for r in got.join(labels, "doc_id").collect() if r.held_out]
    bad, good = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    area = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    assert area > 0.8 and sum(s >= 0.7 for s in good) <= 0.04 * len(good)
