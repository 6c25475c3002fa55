"""Matching by the index against trying every pattern, and the agent dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from headersieve.operators import match as U
from headersieve.operators import pattern_index
from headersieve.operators.lookup import Lookup
from headersieve.operators.pattern_index import PatternIndex, match_texts, required_runs
from headersieve.plans import queries as Q
from headersieve.sources import fixtures
from headersieve.sources.agents import AgentDictionary, fingerprint
from headersieve.sources.fixtures import seed_signatures
from headersieve.sources.signatures import Rules, load_signatures

RULES = "sequence int, id bigint, pattern string"


def test_required_runs(spark):
    cases = [
        ("(?i)chrome/([0-9.]+)", ["chrome/"]),
        ("(?i)Opera Mini|opios", ["opera mini", "opios"]),
        ("(?i)(?:crios|chrome)/[0-9]", None),
        ("(?i)xyz(?:crios|chrome)/[0-9]", ["xyz"]),
        ("fire(?:fox)/([0-9]+)", ["firefox/"]),
        ("fire(fox)?/([0-9]+)", ["fire"]),
        ("(?i)windows nt 10[.]0", ["windows nt 10"]),
        ("abc?def", ["def"]),
        ("abcd?ef", ["abc"]),
        ("abc+de", ["abc"]),
        ("ab{2,}cde", ["cde"]),
        ("x.y|abc", None),
        (r"java\/1\.8 update", ["8 update"]),
        (r"\x41bcdef", None),
        (r"\Qabc.def\E", None),
        ("(?x)abc def", None),
        ("(?iu)kelvin", None),
        ("[a-z&&[^b]]cdef", None),
        (r"[\]a]bcde", ["bcde"]),
        ("[]a]bcde", ["bcde"]),
        ("((((((((((abc))))))))))", None),
        ("(?!no)way out", ["way out"]),
        ("(ab)+cd", None),
        ("(abc)+cd", ["abc"]),
        ("", None),
        ("^$", None),
    ]
    rows = spark.createDataFrame([(pattern,) for pattern, _ in cases], "p string")
    found = {r[0]: r[1] for r in rows.select("p", required_runs(F.col("p"))).collect()}
    assert found == dict(cases)


def _piece(draw, depth):
    words = ["chrome", "Fox", "os ", "mini/", "a", "1.0", "MOB"]
    kind = draw.randrange(9 if depth else 6)
    if kind < 3:
        return draw.choice(words).replace(".", "[.]")
    if kind == 3:
        return draw.choice(["[0-9.]+", "[a-z]", "[^ ]*", r"\d", r"\.", ".", "[]x]", r"\w+"])
    if kind == 4:
        return draw.choice("abcx") + draw.choice(["?", "+", "*", "{2}", "+?", "{0,3}"])
    if kind == 5:
        return draw.choice([" ", "/", "-"])
    inner = "".join(_piece(draw, depth - 1) for _ in range(draw.randrange(1, 4)))
    if kind == 6:
        inner += "|" + draw.choice(words)
    return draw.choice(["(", "(?:", "(?="]) + inner + ")" + draw.choice(["", "", "?", "+", "{1,2}"])


def _equal_to_first_match(spark, patterns, texts, **options):
    rows = spark.createDataFrame([(s, i, p) for s, i, p in patterns], RULES)
    table = spark.createDataFrame([(t,) for t in texts], "text string").distinct()
    index = PatternIndex.build(rows)
    ordered = [(r["id"], r["pattern"]) for r in rows.orderBy("sequence", "id", "pattern").collect()]
    got = {r["text"]: r["hit"] for r in match_texts(table, index, **options).collect()}
    want = table
    want = want.withColumn("hit", F.lit(None).cast("struct<id:bigint,version:string>"))
    for k in range(0, len(ordered), 400):
        want = want.withColumn("hit", F.coalesce("hit", U.first_match(F.col("text"), ordered[k : k + 400])))
    want = {r["text"]: r["hit"] for r in want.collect()}
    wrong = [(t, got.get(t), want[t]) for t in want if got.get(t) != want[t]]
    assert not wrong and set(got) == set(want), wrong[:3]
    return index, want


@pytest.mark.parametrize("block", [3, 500])
def test_random_patterns(spark, block):
    draw = random.Random(block)
    patterns = []
    for k in range(150):
        text = "".join(_piece(draw, 2) for _ in range(draw.randrange(1, 6)))
        text = text + "|" + _piece(draw, 1) if draw.random() < 0.2 else text
        patterns.append((draw.randrange(40), k, draw.choice(["(?i)", "(?i)", ""]) + text))
    patterns += patterns[:5]  # repeated rules
    words = ["chrome", "CHROME", "fox", "Os ", "mini/", "aa", "xx", "1.0", "mob", " ", "/", "é", "K", "ſ", "ab", "-"]
    texts = ["".join(draw.choices(words, k=draw.randrange(0, 9))) for _ in range(250)] + ["", "x", "ab"]
    _, want = _equal_to_first_match(spark, patterns, texts, block=block)
    assert 20 < sum(h is not None for h in want.values())


@pytest.mark.parametrize(("count", "small"), [(1200, True), (5000, False)])
def test_many_patterns(spark, monkeypatch, count, small):
    monkeypatch.setattr(pattern_index, "fits_broadcast", lambda df: small)
    draw = random.Random(count)
    patterns = [
        (draw.randrange(count), k, draw.choice(["(?i)app{0}/([0-9.]+)", "(?i)(?:app|tool){0} v([0-9]+)", "(?i)maker{1}.*app{0}"]).format(k, k % 9))
        for k in range(count)
    ]
    texts = [
        f"{draw.choice(['Mozilla/5.0', 'maker', 'Maker' + str(draw.randrange(9))])} {draw.choice(['App', 'app', 'tool'])}{draw.randrange(count)}{draw.choice(['/', ' v', 'x'])}{draw.randrange(30)}.{draw.randrange(9)}"
        for _ in range(3000)
    ]
    index, want = _equal_to_first_match(spark, patterns, texts)
    assert index.rest.count() == 0 and len(want) > 2000
    assert 300 < sum(h is not None for h in want.values())


def test_only_pairs_that_share_a_run_are_tried(spark):
    """The plan joins on the gram: no pattern meets every text."""
    rows = spark.createDataFrame([(k, k, f"app{k}/") for k in range(100)], RULES)
    texts = spark.createDataFrame([("app7/1",), ("none",)], "text string")
    found = match_texts(texts, PatternIndex.build(rows))
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert {r["text"]: r["hit"]["id"] for r in found.collect() if r["hit"]} == {"app7/1": 7}


def test_log_rows_are_neither_written_nor_moved(spark, monkeypatch):
    """With many patterns only distinct texts are written; a hot agent's rows stay where they are."""
    written = []
    real = U.materialize
    monkeypatch.setattr(U, "materialize", lambda df, label: written.append((label, df.count())) or real(df, label))
    rules = load_signatures(seed_signatures(spark), block=2).clients
    rows = [(i, "Chrome/1" if i % 3 else f"Firefox/{i % 5}") for i in range(900)]
    df = spark.createDataFrame(rows, "log_id bigint, user_agent string")
    matched = U.match_rules(df, rules, F.col("user_agent"), "hit")
    assert matched.count() == 900 and {n for _, n in written} == {6}
    assert "hashpartitioning" not in matched._jdf.queryExecution().executedPlan().toString()


def test_rules_are_listed_or_indexed(spark):
    few = load_signatures(seed_signatures(spark))
    many = load_signatures(seed_signatures(spark), block=2)
    assert isinstance(few.clients, Rules) and few.clients.index is None and len(few.clients.patterns) == 4
    assert many.clients.patterns is None and many.clients.index is not None


def test_dictionary_identifies_only_new_agents(spark, tmp_path, monkeypatch):
    signatures = load_signatures(seed_signatures(spark), block=2)
    asked = []
    from headersieve.sources import agents as G

    real = G.identify_agents
    monkeypatch.setattr(G, "identify_agents", lambda df, s: asked.append({r[0] for r in df.collect()}) or real(df, s))
    dictionary = AgentDictionary(spark, str(tmp_path), signatures)
    ip = "1.1.1.1"
    first = [(1, "Chrome/1", ip), (2, "Chrome/1", ip), (3, "Mozilla/5.0 (compatible; bingbot/2.0)", ip), (4, None, ip), (5, "", ip)]
    second = [(6, "Chrome/1", ip), (7, "Firefox/9 linux", ip), (8, "Firefox/9 linux", ip), (9, "nobody", ip)]
    for rows in (first, second):
        df = spark.createDataFrame(rows, "log_id bigint, user_agent string, ip string")
        got = U.parse_user_agents(df, signatures, agents=dictionary)
        want = U.parse_user_agents(df, signatures, "distinct")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert asked == [{"Chrome/1", "Mozilla/5.0 (compatible; bingbot/2.0)", ""}, {"Firefox/9 linux", "nobody"}]
    assert dictionary.known().count() == 5


def test_dictionary_of_other_patterns_is_another(spark, tmp_path):
    tables = seed_signatures(spark)
    other = dict(tables)
    other["client_regex"] = tables["client_regex"].filter("client_id <> 1")
    renamed = dict(tables)
    renamed["client_list"] = tables["client_list"].withColumn("vendor", F.lit("new"))
    marks = [fingerprint(load_signatures(t)) for t in (tables, tables, other, renamed)]
    assert marks[0] == marks[1] == marks[3] != marks[2]


def test_two_writers_do_no_harm(spark, tmp_path):
    signatures = load_signatures(seed_signatures(spark))
    df = spark.createDataFrame([("Chrome/1",), ("Firefox/2",)], "user_agent string")
    one, two = (AgentDictionary(spark, str(tmp_path), signatures) for _ in range(2))
    one.add(df)
    rows = spark.read.parquet(one.home)
    rows.write.mode("append").parquet(two.home)  # as a writer that began before the first had ended
    assert one.known().count() == 2 and two.add(df) == 0


def test_strategies_agree_on_many_patterns(spark, sf_dir):
    signatures = Q._pattern_signatures(spark, sf_dir)
    agents = fixtures.grown_agents(spark, sf_dir).limit(200).select("user_agent", F.lit("9.9.9.9").alias("ip"))
    distinct = U.parse_user_agents(agents, signatures, "distinct")
    large = Lookup(U.identify_agents(agents, signatures), "user_agent", False)
    joined = U.classify_ip(U.describe_identified(agents, large, signatures), signatures)
    assert distinct.count() == 200
    assert distinct.exceptAll(joined).isEmpty() and joined.exceptAll(distinct).isEmpty()
    assert distinct.filter("ua.ua_family_code <> ''").count() > 100


def test_runs_in_groups(spark):
    cases = [
        ("(?i)(?:none|large-ring12)/([0-9.]+)", ["none", "large-ring12"]),
        ("(crios|chrome)+x[0-9]", ["crios", "chrome"]),
        ("(crios|chrome)+?/abcdefgh", ["/abcdefgh"]),
        ("(opr|opera)/x|(?:edge|trident)[0-9]", ["opr", "opera", "edge", "trident"]),
        ("(x(opr|opera))+/[0-9]", ["opr", "opera"]),
        ("(crios|chrome)?/x", None),
        ("(crios|chrome){0,2}/x", None),
        ("(?!crios|chrome)/x", None),
        ("(crios|)/x", None),
        ("(|crios)/x", None),
        ("(crios|cd?)/x", None),
        ("(?:abc|(?:def|ghi)j)x", None),
        ("abc\x01def\x01ghi", None),
    ]
    rows = spark.createDataFrame([(pattern,) for pattern, _ in cases], "p string")
    found = {r[0]: r[1] for r in rows.select("p", pattern_index.runs_in_groups(F.col("p"))).collect()}
    assert found == dict(cases)


def test_rules_whose_runs_stand_in_a_group_are_indexed(spark):
    """Alternatives in a group, none of them with a run beside it, are not tried on every text."""
    rules = [(k, k, f"(?i)(?:none|large-ring{k})/([0-9.]+)") for k in range(50)]
    index, want = _equal_to_first_match(spark, rules, [f"Large-Ring{k}/{k}.0" for k in range(60)] + ["none/7", "x"])
    assert index.rest.count() == 0 and sum(h is not None for h in want.values()) == 51


@pytest.mark.parametrize("small", [True, False])
def test_texts_meet_few_patterns_however_many_share_their_letters(spark, monkeypatch, small):
    """Runs that differ in digits alone are told apart, and repeats of a pattern are kept once."""
    monkeypatch.setattr(pattern_index, "fits_broadcast", lambda df: small)
    rules = [(k, k, f"(?i)large-ring{k:05}/([0-9.]+)") for k in range(3000)]
    rules += [(9000 - k, k, "(?i)large-ring[0-9]*4/([0-9.]+)") for k in range(3000)]
    texts = [f"Large-Ring{k:05}/{k}.1" for k in range(2900, 3100)]
    index, _ = _equal_to_first_match(spark, rules, texts)
    assert index.ruled.count() == 3001 and index.ruled.filter("id = 2999").count() == 2
    table = spark.createDataFrame([(t.lower(),) for t in texts], "text string")
    windows = F.explode(F.concat(*(pattern_index.grams_of(F.col("text"), size) for size in index.sizes)))
    assert table.select("text", windows.alias("gram")).join(index.keyed, "gram").count() < 5 * len(texts)
