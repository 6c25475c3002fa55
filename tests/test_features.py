"""Pairs, vocabularies, slots, labels and samples against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from headersieve.functions import headers as H
from headersieve.functions.fixed_values import ORDER_HEADERS
from headersieve.functions.pairs import ORDER_SLOTS, ORDER_WIDTH, header_pairs, order_slots
from headersieve.operators import features as X
from headersieve.operators import labels as Y
from headersieve.operators import sampling as A
from headersieve.operators.lookup import Lookup

ORDER = "log_id bigint, order_data map<string,int>"
VALUES = "log_id bigint, value_data map<string,string>, order_data map<string,int>"


def brute_pairs(order):
    """Pairs of trimmed headers, the earlier first, equal positions by name."""
    trimmed = sorted((pos, name) for name, pos in order.items() if name in H.ORDER_SPELLINGS)
    return {f"{a} < {b}" for (_, a), (_, b) in combinations(trimmed, 2)}


def random_orders(n=400):
    rng = random.Random(5)
    names = [*H.ORDER_SPELLINGS, "Referer", "X-K"]
    return [
        {name: rng.randrange(8) for name in rng.sample(names, rng.randrange(0, 12))} for _ in range(n)
    ]


def test_vocabulary_of_pairs():
    assert ORDER_WIDTH == 49
    assert ORDER_SLOTS["Accept < Accept-Encoding"] == 0
    assert ORDER_SLOTS["User-Agent < Upgrade-Insecure-Requests"] == 48
    assert list(ORDER_SLOTS) == sorted(ORDER_SLOTS)
    assert "From < Host" not in ORDER_SLOTS and "Host < From" in ORDER_SLOTS


@pytest.mark.parametrize("unknown", ["slot0", "drop"])
def test_pairs_and_slots_against_brute_force(spark, unknown):
    orders = random_orders()
    df = spark.createDataFrame(list(enumerate(orders)), ORDER)
    rows = df.select(
        "log_id",
        header_pairs(F.col("order_data")).alias("pairs"),
        order_slots(F.col("order_data"), unknown).alias("slots"),
    ).collect()
    assert len(rows) == len(orders)
    for row in rows:
        pairs = brute_pairs(orders[row["log_id"]])
        assert len(row["pairs"]) == len(pairs) and set(row["pairs"]) == pairs
        default = 0 if unknown == "slot0" else None
        slots = {ORDER_SLOTS.get(p, default) for p in pairs} - {None}
        assert row["slots"] == sorted(slots)


def test_number_of_pairs(spark):
    order = {name: i for i, name in enumerate(ORDER_HEADERS)}
    df = spark.createDataFrame([(1, order)], ORDER)
    assert len(df.select(header_pairs(F.col("order_data"))).first()[0]) == 8 * 7 // 2


def test_trimming_keeps_six_positions_and_two_values(spark):
    order = {"Host": 0, "Connection": 1, "accept": 2, "From": 3, "User-Agent": 4,
             "Accept-Encoding": 5, "Random_header": 6}
    values = {"Host": "h", "Connection": "c", "Accept": "a", "From": "f", "User-Agent": "u",
              "accept-encoding": "e", "If-Modified-Since": "t"}
    row = spark.createDataFrame([(1, values, order)], VALUES).select(
        H.trim_order(F.col("order_data")).alias("o"), H.trim_values(F.col("value_data")).alias("v")
    ).first()
    assert len(row["o"]) == 6 and "Random_header" not in row["o"]
    assert row["v"] == {"Accept": "a", "accept-encoding": "e"}


def test_shouted_spelling_is_not_kept(spark):
    df = spark.createDataFrame([(1, {"ACCEPT": 0, "HOST": 1})], ORDER)
    assert df.select(H.trim_order(F.col("order_data"))).first()[0] == {}


def logs_with_values(spark, n=300):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        values = {h: f"v{rng.randrange(6)}" for h in rng.sample(H.VALUE_SPELLINGS, rng.randrange(0, 5))}
        values["Host"] = "h"
        rows.append((i, values, {h: p for p, h in enumerate(values)}))
    return rows, spark.createDataFrame(rows, VALUES)


def test_value_vocabulary_is_dense_unique_and_sorted(spark):
    rows, df = logs_with_values(spark)
    expected = sorted({f"{h}={v}" for _, values, _ in rows for h, v in values.items() if h != "Host"})
    fitted = {r["feature_name"]: r["idx"] for r in X.fit_value_vocabulary(df).collect()}
    assert fitted == {name: i for i, name in enumerate(expected)}


@pytest.mark.parametrize("unknown", ["slot0", "drop"])
@pytest.mark.parametrize("small", [True, False])
def test_value_slots_against_brute_force(spark, unknown, small):
    rows, df = logs_with_values(spark)
    vocabulary = X.fit_value_vocabulary(df.filter("log_id < 8"))
    known = {r["feature_name"]: r["idx"] for r in vocabulary.collect()}
    slots = X.value_features(df, Lookup(vocabulary, "feature_name", small), unknown).collect()
    assert len(slots) == len(rows)
    for row in slots:
        keys = [f"{h}={v}" for h, v in row["value_data"].items() if h in H.VALUE_SPELLINGS]
        default = 0 if unknown == "slot0" else None
        assert row["value_slots"] == sorted({known.get(k, default) for k in keys} - {None})


def test_full_features_follow_order_slots(spark):
    _, df = logs_with_values(spark)
    vocabulary = X.fit_value_vocabulary(df)
    for row in X.full_features(df, vocabulary).collect():
        assert row["positions"] == sorted(set(row["positions"]))
        values = sum(h in H.VALUE_SPELLINGS for h in row["value_data"])
        assert sum(p >= ORDER_WIDTH for p in row["positions"]) == values


def test_expected_cells_of_the_fixture(spark, sf_dir):
    from headersieve.plans import queries as Q

    shredded = Q._shredded(spark, sf_dir)
    total = shredded.count()
    cells = X.sparse_cells(X.full_features(shredded, X.fit_value_vocabulary(shredded)))
    by_column = {r["column"]: r["count"] for r in cells.groupBy("column").count().collect()}
    assert len(by_column) == 28
    assert {c: by_column[c] * 10 // total for c in (0, 1, 2, 3, 9, 6)} == {
        0: 6, 1: 2, 2: 2, 3: 2, 9: 2, 6: 4,
    }


def test_label_codes(spark):
    rows = [(i, 100 - i, label) for i, label in enumerate(["c", "a", "b", "a", "c", "d"])]
    df = spark.createDataFrame(rows, "log_id bigint, timestamp int, ua string")
    codes = Y.fit_label_codes(df, "ua")
    assert {r["text"]: r["int_code"] for r in codes.collect()} == {"d": 0, "c": 1, "a": 2, "b": 3}
    more = spark.createDataFrame([(1, "b"), (2, "zz")], "log_id bigint, ua string")
    coded = {r["ua"]: (r["int_code"], r["float_code"]) for r in Y.encode_label(more, codes, "ua").collect()}
    assert coded == {"b": (3, 3.0), "zz": (0, 0.0)}
    decoded = Y.decode_label(Y.encode_label(df, codes, "ua"), codes, "int_code")
    assert decoded.filter("text != ua").isEmpty() and decoded.count() == 6
    assert {r["ua"]: r["label"] for r in Y.one_hot_labels(more, codes, "ua").collect()} == {"b": 3, "zz": 0}


TIMED = "log_id bigint, timestamp timestamp, ua_family_code string"


def timed(spark, n=200, families=5):
    rng = random.Random(3)
    rows = [(i, rng.randrange(40), f"f{rng.randrange(families)}") for i in range(n)]
    df = spark.createDataFrame(rows, "log_id bigint, epoch bigint, ua_family_code string")
    return rows, df.select("log_id", F.timestamp_seconds("epoch").alias("timestamp"), "ua_family_code")


@pytest.mark.parametrize("n", [0, 1, 17, 199, 200, 1000])
def test_newest_and_first_n_settle_ties_by_id(spark, n):
    rows, df = timed(spark)
    newest = sorted(((e, i) for i, e, _ in rows), reverse=True)[:n]
    assert {r["log_id"] for r in A.newest_logs(df, n).collect()} == {i for _, i in newest}
    first = sorted((e, i) for i, e, _ in rows if 5 <= e <= 30)[:n]
    assert {r["log_id"] for r in A.first_n_in_period(df, 5, 30, n).collect()} == {i for _, i in first}


@pytest.mark.parametrize("buckets, few", [(64, 1), (1024, 50)])
@pytest.mark.parametrize("newest", [True, False])
def test_nth_key_by_histograms(spark, monkeypatch, buckets, few, newest):
    """One moment that holds a third of all rows, times before 1970, ids of either sign, repeated keys."""
    monkeypatch.setattr(A, "BUCKETS", buckets)
    monkeypatch.setattr(A, "FEW_KEYS", few)
    rng = random.Random(buckets)
    times = [rng.choice([-7_000_000, 0, rng.randrange(-50, 50), rng.randrange(-(10**12), 10**15)]) for _ in range(150)]
    rows = [(t, rng.choice([rng.randrange(-9, 9), rng.randrange(-(2**62), 2**62)])) for t in [*times, *[5] * 70]]
    df = spark.createDataFrame([*rows, (None, 1)], "at bigint, log_id bigint").select(
        F.timestamp_micros("at").alias("timestamp"), "log_id"
    )
    order = sorted(rows, reverse=newest)
    for n in (1, 110, len(rows)):
        want = order[n - 1] if n < len(rows) else None
        assert A.nth_key(df.filter("timestamp IS NOT NULL"), n, newest) == want
    got = A.newest_logs(df, 100) if newest else A._up_to_nth(df, 100, newest=False)
    assert got.count() == sum((r >= order[99]) if newest else (r <= order[99]) for r in rows)


def test_selection_neither_sorts_nor_limits(spark):
    _, df = timed(spark)
    plan = A.newest_logs(df, 17)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Limit" not in plan and "Exchange" not in plan


def test_period_includes_both_ends(spark):
    rows, df = timed(spark)
    assert A.logs_in_period(df, 7, 9).count() == sum(7 <= e <= 9 for _, e, _ in rows)


def test_newest_first_rows(spark):
    rows, df = timed(spark)
    order = sorted(((e, i) for i, e, _ in rows), reverse=True)
    found = {r["log_id"]: r["row"] for r in X.newest_first_rows(df).collect()}
    assert found == {i: place for place, (_, i) in enumerate(order)}


def test_empty_sample(spark):
    empty = spark.createDataFrame([], TIMED)
    assert A.newest_logs(empty, 10).isEmpty()
    assert A.sample_summary(empty).first()["logs"] == 0


@pytest.mark.parametrize("seed", [None, 1, 2, 3])
@pytest.mark.parametrize("families", [2, 3, 9])
def test_false_families_are_a_derangement(spark, seed, families):
    rows, df = timed(spark, families=families)
    pairs = [tuple(r) for r in A.false_families(df, seed).collect()]
    assert len(pairs) == families
    assert all(own != false for own, false in pairs)
    assert {own for own, _ in pairs} == {false for _, false in pairs}
    bots = A.make_bot_sample(df, seed)
    assert bots.count() == len(rows)
    assert bots.filter("original_ua_family_code = ua_family_code").isEmpty()


def test_a_single_family_keeps_itself(spark):
    _, df = timed(spark, families=1)
    assert [tuple(r) for r in A.false_families(df).collect()] == [("f0", "f0")]


def test_prepare_period(spark, sf_dir):
    from headersieve.plans import queries as Q

    logs = Q._stored(spark, sf_dir)
    features, vocabulary, codes = X.prepare_period(logs, *Q.period(spark, sf_dir))
    assert features.count() == A.logs_in_period(logs, *Q.period(spark, sf_dir)).count() > 0
    assert features.agg(F.max("label")).first()[0] == codes.count() - 1
    assert vocabulary.count() > 0


def test_period_is_read_once(spark, sf_dir, monkeypatch):
    """Vocabulary, codes and features come from the written period, none from the logs again."""
    from headersieve.plans import queries as Q

    logs, read = Q._stored(spark, sf_dir), []
    real = X.materialize
    monkeypatch.setattr(X, "materialize", lambda df, label: (read.append("FileScan parquet" in (p := df._jdf.queryExecution().executedPlan().toString()) and p.count("log_date")), real(df, label))[1])
    features, vocabulary, codes = X.prepare_period(logs, *Q.period(spark, sf_dir))
    assert sum(bool(n) for n in read) == 1
    for table in (features, vocabulary, codes):
        assert "log_date" not in table._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bits", [7, 24])
def test_unseen_values_do_not_move(spark, monkeypatch, bits):
    """Only values that the table of bits lets through reach the join."""
    monkeypatch.setattr(X, "TABLE_BITS", bits)
    rows = [(i, {"Accept": f"v{i % 40}", "Accept-Encoding": "gzip" if i % 3 else "never"}) for i in range(400)]
    df = spark.createDataFrame(rows, "log_id bigint, value_data map<string,string>")
    known = {f"Accept=v{k}": k for k in range(10)} | {"Accept-Encoding=gzip": 10}
    vocabulary = spark.createDataFrame(list(known.items()), "feature_name string, idx int")
    for unknown in ("slot0", "drop"):
        got = {r["log_id"]: r["value_slots"] for r in X.value_features(df, Lookup(vocabulary, "feature_name", False), unknown).collect()}
        default = 0 if unknown == "slot0" else None
        assert got == {i: sorted({known.get(f"{k}={v}", default) for k, v in m.items()} - {None}) for i, m in rows}
    assert X.vocabulary_bits(vocabulary).count() <= 1 << (bits - 6)
