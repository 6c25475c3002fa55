"""Queries that must read all lines, and take them apart once."""

from headersieve.plans import queries as Q


def _events(spark, path, ids):
    rows = [(i, i, "view") for i in ids]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_value_features_know_the_values_of_all_lines(spark, tmp_path):
    """The vocabulary holds values of lines whose number is no multiple of five."""
    where = _events(spark, tmp_path, [1, 2, 3, 6, 8])
    slots = {r["slot"] for r in Q.value_features(spark, where).collect()}
    assert len(slots) > 1


def test_model_refresh_takes_lines_apart_once(spark, tmp_path, monkeypatch):
    where, calls, real = _events(spark, tmp_path, range(24)), [], Q._shredded
    monkeypatch.setattr(Q, "_shredded", lambda *a: calls.append(a) or real(*a))
    verdicts = Q.stream_model_refresh(spark, where).collect()
    assert len(calls) == 1 and {r["request_id"] for r in verdicts} == set(range(24))
    assert {r["model_version"] for r in verdicts} == {1, 2}
