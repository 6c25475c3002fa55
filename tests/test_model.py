"""Scoring, training, verdicts and error rates."""

import math
import random

import pytest
from pyspark.sql import functions as F

from headersieve.functions.scoring import LinearScorer, human_verdict
from headersieve.operators import model as M
from headersieve.operators import verdict as V
from headersieve.operators.scorer import TableScorer
from headersieve.sources.fixtures import fixed_coefficients

SET = "log_id bigint, family string, positions array<int>"


def positions_frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "log_id bigint, positions array<int>")


def brute(scorer, positions):
    sums = list(scorer.intercepts)
    for p in positions:
        if p < scorer.width:
            sums = [s + w for s, w in zip(sums, scorer.weights[p])]
    sigmoids = [1 / (1 + math.exp(-s)) for s in sums]
    return {c: round(s / sum(sigmoids), 5) for c, s in zip(scorer.classes, sigmoids)}


def random_scorer(classes=4, width=30):
    rng = random.Random(1)
    return LinearScorer(
        [f"c{i}" for i in range(classes)],
        [rng.uniform(-2, 2) for _ in range(classes)],
        [[rng.uniform(-2, 2) for _ in range(classes)] for _ in range(width)],
    )


def random_positions(n=200, width=35):
    rng = random.Random(2)
    return [sorted(rng.sample(range(width), rng.randrange(0, 9))) for _ in range(n)]


def test_scores_against_brute_force(spark):
    scorer, rows = random_scorer(), random_positions()
    scored = V.score_families(positions_frame(spark, rows), scorer).collect()
    assert len(scored) == len(rows)
    for row in scored:
        if not row["positions"]:
            assert row["probs"] is None
            continue
        expected = brute(scorer, row["positions"])
        assert row["probs"] == pytest.approx(expected, abs=1.1e-5)
        assert sum(row["probs"].values()) == pytest.approx(1, abs=1e-4)


def test_scores_by_join_agree(spark):
    """Any number of set columns, by groups: the same last digit as in one expression."""
    scorer, rows = random_scorer(), random_positions()
    df = positions_frame(spark, rows)
    coefficients = M.FamilyModel(scorer, None).export_coefficients(spark)
    joined = {}
    for r in V.score_by_join(df, coefficients).collect():
        joined.setdefault(r["log_id"], {})[r["class"]] = r["prob"]
    in_place = {r["log_id"]: r["probs"] for r in V.score_families(df, scorer).collect()}
    assert joined == {log_id: probs for log_id, probs in in_place.items() if probs}


def test_scores_by_join_move_rows_once_and_before_they_become_cells(spark):
    """With weights that fit a broadcast neither cells nor classes are shuffled; repeated and null ids meet."""
    scorer = random_scorer()
    coefficients = M.FamilyModel(scorer, None).export_coefficients(spark)
    schema = "log_id bigint, positions array<int>"
    df = spark.createDataFrame([(1, [0, 3]), (2, [1]), (1, [4]), (None, [2]), (None, [2])], schema)
    scores = V.score_by_join(df, coefficients)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(log_id") == 1
    assert plan.index("Generate explode(__cells") < plan.index("hashpartitioning(log_id")
    got = {(r["log_id"], r["class"]): r["prob"] for r in scores.collect()}
    assert len(got) == 3 * len(scorer.classes)
    raw = {}
    for log_id, cells in ((1, [-1, -1, 0, 3, 4]), (2, [-1, 1]), (None, [-1, -1, 2, 2])):
        sums = [sum((scorer.intercepts if c < 0 else scorer.weights[c])[k] for c in cells) for k in range(len(scorer.classes))]
        raw[log_id] = [1 / (1 + math.exp(-m)) for m in sums]
    for (log_id, name), prob in got.items():
        share = raw[log_id][scorer.classes.index(name)] / sum(raw[log_id])
        assert prob == pytest.approx(share, abs=1.1e-5)


def feature_positions(n, width, seed=5):
    """Rows as features make them: some order slots, then up to six value slots, some beyond the width."""
    rng = random.Random(seed)
    rows = [sorted(rng.sample(range(49), rng.randrange(0, 9))) for _ in range(n)]
    return [r + sorted(rng.sample(range(49, width + 9), rng.randrange(0, 7))) for r in rows]


@pytest.mark.parametrize("bounds", [{}, {"max_rows": 1}])
def test_table_of_weights_scores_like_the_expression(spark, bounds):
    """Broadcast or shuffled, the digits are those of one expression."""
    scorer, rows = random_scorer(width=80), feature_positions(300, 80)
    coefficients = M.FamilyModel(scorer, None).export_coefficients(spark)
    table = TableScorer.from_table(coefficients.repartition(3), **bounds)
    assert table.tail.small == (not bounds) and (table.width, table.classes) == (80, scorer.classes)
    df = positions_frame(spark, rows)
    want = {r["log_id"]: r["probs"] for r in V.score_families(df, scorer).collect()}
    got = {r["log_id"]: r["probs"] for r in V.score_families(df, table).collect()}
    assert got == want and any(want.values()) and None in want.values()


def test_a_vocabulary_of_a_million(spark):
    """Weights stay a table; only those of the order slots come to the driver."""
    width = 1_000_100
    table = TableScorer.from_table(fixed_coefficients(spark, width))
    assert not table.tail.small and table.head.width == 49
    rows = feature_positions(40, width)
    expected = LinearScorer(
        ["chrome", "firefox", "opera"], [-0.1, 0.0, 0.1], []
    )
    for row in V.score_families(positions_frame(spark, rows), table).collect():
        sums = list(expected.intercepts)
        for p in row["positions"]:
            if p < width:
                sums = [s + ((p * 7 + k * 13) % 11 - 5) / 10.0 for k, s in enumerate(sums)]
        sigmoids = [1 / (1 + math.exp(-s)) for s in sums]
        want = {c: round(s / sum(sigmoids), 5) for c, s in zip(expected.classes, sigmoids)}
        assert row["probs"] == (pytest.approx(want, abs=1.1e-5) if row["positions"] else None)


def test_weights_of_order_slots_alone(spark):
    coefficients = fixed_coefficients(spark, 30)
    df = positions_frame(spark, [[1, 2, 29, 30], [], [48], [60, 61, 62, 63, 64, 65, 66]])
    got = V.score_families(df, TableScorer.from_table(coefficients)).orderBy("log_id").collect()
    want = V.score_families(df, LinearScorer.from_table(coefficients)).orderBy("log_id").collect()
    assert got == want
    none = TableScorer.from_table(coefficients.limit(0))
    assert (none.width, none.classes) == (0, []) and V.score_families(df, none).count() == 4


def test_more_value_slots_than_headers_is_an_error(spark):
    table = TableScorer.from_table(fixed_coefficients(spark, 70))
    with pytest.raises(Exception, match="more than 6 value slots"):
        V.score_families(positions_frame(spark, [list(range(49, 56))]), table).collect()


@pytest.mark.parametrize("families", [1, 2, 4])
def test_residual_is_the_gradient(spark, families):
    rows = training_rows(families)
    training_set = spark.createDataFrame(rows, SET).cache()
    model = M.train_family_model(training_set, max_iter=100)
    best = {r["class"]: r["residual"] for r in M.optimality_residual(training_set, model).collect()}
    assert set(best) == set(model.scorer.classes) and all(r < 1e-3 for r in best.values())
    if families == 1:
        return
    # Away from the optimum, against the sums written out.
    off = LinearScorer(model.scorer.classes, [i + 0.3 for i in model.scorer.intercepts], [[w + 0.01 * k for k, w in enumerate(ws)] for ws in model.scorer.weights])
    got = {r["class"]: r["residual"] for r in M.optimality_residual(training_set, M.FamilyModel(off, None)).collect()}
    for k, name in enumerate(off.classes):
        gradient = [w[k] / (100.0 * len(rows)) for w in off.weights] + [0.0]
        for _, family, positions in rows:
            margin = off.intercepts[k] + sum(off.weights[p][k] for p in positions)
            error = (1 / (1 + math.exp(-margin)) - (family == name)) / len(rows)
            for p in [*positions, -1]:
                gradient[p] += error
        assert got[name] == pytest.approx(max(map(abs, gradient)), rel=1e-9) and got[name] > best[name]


def test_threshold_is_strict_and_unknown_family_is_no_human(spark):
    rows = [("a", 0.03), ("a", 0.03001), ("b", 0.5)]
    df = spark.createDataFrame(rows, "family string, p double")
    probs = F.create_map(F.lit("a"), F.col("p"))
    verdicts = [r[0] for r in df.select(human_verdict(probs, F.col("family"))).collect()]
    assert verdicts == [False, True, False]


def training_rows(families, n=240):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        k = i % families
        own = [3 * k, 3 * k + 1] if rng.random() < 0.95 else [3 * k]
        rows.append((i, f"f{k}", sorted({*own, 20 + rng.randrange(4)})))
    return rows


@pytest.mark.parametrize("families", [1, 2, 4])
def test_training_tells_families_apart(spark, families):
    rows = training_rows(families)
    training_set = spark.createDataFrame(rows, SET).cache()
    model = M.train_family_model(training_set, max_iter=30)
    assert model.scorer.classes == [f"f{k}" for k in range(families)]
    assert (model.one_vs_rest is not None) == (families > 2)
    assert model.scorer.width == 24
    scored = V.score_families(training_set, model.scorer).collect()
    for row in scored:
        assert sum(row["probs"].values()) == pytest.approx(1, abs=1e-4)
        assert max(row["probs"], key=row["probs"].get) == row["family"]


def test_exported_weights_score_like_the_trained_model(spark):
    rows = training_rows(4)
    training_set = spark.createDataFrame(rows, SET).cache()
    model = M.train_family_model(training_set, max_iter=30)
    vectors = M.with_vectors(training_set, model.scorer.width)
    raw = model.one_vs_rest.transform(vectors).select("log_id", "rawPrediction", "prediction")
    own = {r["log_id"]: r["probs"] for r in V.score_families(training_set, model.scorer).collect()}
    for row in raw.collect():
        sigmoids = [1 / (1 + math.exp(-m)) for m in row["rawPrediction"]]
        expected = [s / sum(sigmoids) for s in sigmoids]
        probs = own[row["log_id"]]
        assert [probs[c] for c in model.scorer.classes] == pytest.approx(expected, abs=1.1e-5)


def test_vectors_are_sparse_and_ignore_later_columns(spark):
    row = M.with_vectors(positions_frame(spark, [[0, 3, 99]]), 5).first()
    assert row["features"].size == 5
    assert list(row["features"].indices) == [0, 3]


def test_training_set_is_paired_by_id(spark):
    cells = spark.createDataFrame([(2, 5), (1, 0), (2, 1), (1, 0)], "log_id bigint, column int")
    labels = spark.createDataFrame([(1, "a"), (2, "b")], "log_id bigint, name string")
    rows = {r["log_id"]: r for r in M.assemble_training_set(cells, labels).collect()}
    assert rows[1]["positions"] == [0] and rows[1]["family"] == "a"
    assert rows[2]["positions"] == [1, 5] and rows[2]["family"] == "b"
    assert M.trained_width(M.assemble_training_set(cells, labels)) == 6


def test_labelled_logs_without_cells_stay(spark):
    cells = spark.createDataFrame([(2, 5)], "log_id bigint, column int")
    labels = spark.createDataFrame([(1, "a"), (2, "b")], "log_id bigint, name string")
    rows = {r["log_id"]: r["positions"] for r in M.assemble_training_set(cells, labels).collect()}
    assert rows == {1: [], 2: [5]}


def verdicts(spark, word, n):
    return spark.createDataFrame([(word,)] * n, "verdict string") if n else spark.createDataFrame([], "verdict string")


def test_error_rates_divide_by_all_rows(spark):
    humans = verdicts(spark, "bot", 2409).union(verdicts(spark, "human", 27591))
    bots = verdicts(spark, "human", 60).union(verdicts(spark, "bot", 29940))
    row = V.error_rates(bots, humans).first()
    assert (row["error_1"], row["error_2"]) == (4.015, 0.1)
    assert (row["humans_as_bot"], row["bots_as_human"], row["judged"]) == (2409, 60, 60000)


def test_error_rates_of_nothing(spark):
    none = verdicts(spark, "bot", 0)
    row = V.error_rates(none, none).first()
    assert row["judged"] == 0 and row["error_1"] is None


CHROME = "Mozilla/5.0 (Windows NT 10.0) Chrome/60.0.1 Safari/537.36"


@pytest.mark.parametrize(
    ("ip", "body", "verdict"),
    [
        ("", "Host: h\nAccept: */*", "unknown_no_user_agent"),
        ("1.1.1.1", "Host: h\nAccept: */*", "bot"),
        ("1.1.1.1", "Host: h\nUser-Agent: Java/1.8", "crawler"),
        ("10.8.0.7", f"Host: h\nUser-Agent: {CHROME}", "crawler"),
        ("1.1.1.1", f"Host: h\nUser-Agent: {CHROME}", "human"),
        ("1.1.1.1", f"User-Agent: {CHROME}\nHost: h", "bot"),
        ("1.1.1.1", f"User-Agent: {CHROME}", "bot"),
        ("1.1.1.1", "Host: h\nUser-Agent: Nobody/1", "bot"),
    ],
)
def test_request_verdicts(spark, signatures, ip, body, verdict):
    """A model that believes Chrome when the host comes before the agent."""
    from headersieve.functions.pairs import ORDER_SLOTS

    weights = [[0.0, 0.0] for _ in range(50)]
    weights[ORDER_SLOTS["User-Agent < Host"]] = [-20.0, 20.0]
    scorer = LinearScorer(["chrome", "other"], [0.0, 0.0], weights)
    vocabulary = spark.createDataFrame([("Accept=*/*", 0)], "feature_name string, idx int")
    requests = spark.createDataFrame([(1, ip, body)], "request_id bigint, client_ip string, body string")
    judged = V.judge_requests(requests, signatures, vocabulary, scorer)
    assert [r["verdict"] for r in judged.collect()] == [verdict]


def test_missing_scores_are_an_error_verdict(spark):
    row = spark.createDataFrame([(1, "a", "1.1.1.1", [1])], "id int, user_agent string, client_ip string, positions array<int>")
    unscored = row.select(
        "*",
        F.lit(None).cast("map<string,double>").alias("probs"),
        F.struct(F.lit("").alias("ua_class_code"), F.lit("a").alias("ua_family_code")).alias("ua"),
        F.struct(F.lit("").alias("ip_classification_code")).alias("address"),
    )
    assert unscored.select(V.request_verdict()).first()[0] == "error"


def test_sorted_order_option(spark, sf_dir):
    from headersieve.plans import queries as Q

    logs = Q._stored(spark, sf_dir)
    vocabulary, width = Q._vocabulary(spark, sf_dir)
    scorer = Q._fixed_scorer(spark, width, Q.SHARP)
    stored = V.verdict_counts(V.judge_logs(logs, vocabulary, scorer)).collect()
    by_name = V.verdict_counts(V.judge_logs(logs, vocabulary, scorer, order="sorted")).collect()
    assert sum(r["requests"] for r in stored) == sum(r["requests"] for r in by_name)
