"""Lines and bodies taken apart, by hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from headersieve.functions import headers as H
from headersieve.operators import shred as S
from headersieve.sources.fixtures import seed_signatures
from headersieve.sources.signatures import load_signatures

CHROME = "Mozilla/5.0 (Windows NT 10.0) Chrome/60.0.1 Safari/537.36"
BING = "Mozilla/5.0 (compatible; bingbot/2.0)"


def line(headers, epoch=1503090000, ip="1.2.3.4"):
    text = headers if isinstance(headers, str) else json.dumps(headers).replace("/", "\\/")
    return f"{epoch},{ip},'{text}'"


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "log_id bigint, line string")


def entries(spark, text):
    df = spark.createDataFrame([(text,)], "header_json string")
    row = S.header_entries(df).first()
    return None if row["entries"] is None else [tuple(e) for e in row["entries"]]


def maps(spark, text):
    row = S.shred_headers_json(spark.createDataFrame([(text,)], "header_json string")).first()
    return row["value_data"], row["order_data"]


def test_headers_keep_document_order(spark):
    names = ["Host", "User-Agent", "Accept", "X", "a", "B", "From", "Connection"]
    text = json.dumps({n: n.lower() for n in names})
    assert entries(spark, text) == [(n, n.lower(), i) for i, n in enumerate(names)]


def test_leading_whitespace_is_allowed(spark):
    assert entries(spark, '\n\t\t {"A": "1"}') == [("A", "1", 0)]


def test_last_of_a_repeated_header_wins_and_positions_go_on(spark):
    text = '{"A":"1","B":"2","A":"3","C":"4"}'
    assert entries(spark, text) == [("B", "2", 1), ("A", "3", 2), ("C", "4", 3)]
    assert maps(spark, text) == ({"A": "3", "B": "2", "C": "4"}, {"A": 2, "B": 1, "C": 3})


def test_values_of_other_types_are_kept_as_text(spark):
    text = '{"n":5,"t":true,"o":{"x":[1,2]},"z":null}'
    values, order = maps(spark, text)
    assert values == {"n": "5", "t": "true", "o": '{"x":[1,2]}', "z": "null"}
    assert order == {"n": 0, "t": 1, "o": 2, "z": 3}


@pytest.mark.parametrize("text", ['{"A":"1"', "[1]", "x", '{"A" "1"}'])
def test_malformed_json_gives_null(spark, text):
    assert entries(spark, text) is None
    assert maps(spark, text) == (None, None)


def test_empty_object_has_no_headers(spark):
    assert maps(spark, "{}") == ({}, {})


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        (r"'{\"a\":\"*\/*\"}'", r"{\"a\":\"*/*\"}"),
        ("''x''", "'x'"),
        ("'", ""),
        ("", ""),
        ("plain", "plain"),
    ],
)
def test_clean_header_json(spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "headers string")
    assert df.select(H.clean_header_json(F.col("headers"))).first()[0] == clean


def test_headers_are_all_behind_the_second_comma(spark):
    row = S.split_log_line(lines(spark, "1503090000,1.2.3.4,'{\"a\":\"x,y,z\"}'")).first()
    assert (row["epoch_text"], row["ip"]) == ("1503090000", "1.2.3.4")
    assert row["headers"] == "'{\"a\":\"x,y,z\"}'"


REASONS = {
    "": "malformed_line",
    "1503090000": "malformed_line",
    "1503090000,1.2.3.4": "malformed_line",
    "1503090000,,'{}'": "empty_ip",
    "15030900xx,1.2.3.4,'{}'": "bad_timestamp",
    "0000000001,1.2.3.4,'{}'": "outside_time_range",
    "1503090000;1.2.3.4,'{}'": "too_few_parts",
    "1503090000,1.2.3.4,": "empty_headers",
    '1503090000,1.2.3.4,{"User-Agent":"x"}': "unquoted_headers",
    "1503090000,1.2.3.4,'{\"Host\"'": "malformed_json",
    "1503090000,1.2.3.4,'{\"Host\":\"h\"} trailing'": "malformed_json",
    line({"Host": "h"}): "no_user_agent_key",
    line({"User-Agent": ""}): "empty_user_agent",
    line({"User-Agent": "Java/1.8"}): "crawler",
    line({"User-Agent": BING}): "crawler",
    line({"User-Agent": "Nobody/1.0"}): "empty_ua_family",
    line({"User-Agent": CHROME}, ip="10.8.0.7"): "crawler",
    line({"User-Agent": CHROME}): None,
    line({"user-agent": CHROME}): None,
    line({"User-Agent": "", "user_agent": CHROME}): None,
}


def test_reject_reasons(spark, signatures):
    rejected = S.reject_reason(lines(spark, *REASONS), signatures, start=1500000000)
    found = {r["line"]: r["reason"] for r in rejected.collect()}
    assert found == REASONS
    accepted = S.parse_log_lines(lines(spark, *REASONS), signatures, start=1500000000)
    assert accepted.count() == sum(reason is None for reason in REASONS.values())


def test_options_of_the_legacy_behaviour(spark, signatures):
    texts = (line({"user-agent": CHROME}), line({"User-Agent": BING}))
    legacy = S.reject_reason(
        lines(spark, *texts), signatures, legacy_ua_pick=True, words_only=True
    )
    assert [r["reason"] for r in legacy.orderBy("log_id").collect()] == ["empty_user_agent", None]


def test_unfiltered_lines_are_still_parsed(spark, signatures):
    parsed = S.parse_log_lines(
        lines(spark, line({"User-Agent": BING}), line({"User-Agent": CHROME})),
        signatures,
        filter_crawlers=False,
    )
    rows = {r["ua_family_code"]: r for r in parsed.collect()}
    assert set(rows) == {"bingbot", "chrome"}
    assert rows["chrome"]["ua_version"] == "chrome 60.0.1"
    assert rows["chrome"]["os_code"] == "windows_10"
    assert rows["chrome"]["device_class_code"] == "desktop"


def test_lines_without_agent_parsing(spark, signatures):
    parsed = S.parse_log_lines(
        lines(spark, line({"User-Agent": "Nobody/1.0"})), signatures, need_ua=False
    )
    assert "ua_family_code" not in parsed.columns
    logs = S.project_logs(parsed).first()
    assert logs["ua_family_code"] == "" and logs["user_agent"] == "Nobody/1.0"


@pytest.mark.parametrize(
    ("start", "finish", "kept"),
    [
        (1503090002, 1503090019, 2),
        (1503090003, 1503090018, 0),
        (None, 1503090002, 1),
        (1503090019, None, 1),
        (None, None, 2),
    ],
)
def test_time_range_includes_both_ends(spark, start, finish, kept):
    df = spark.createDataFrame([(1503090002,), (1503090019,)], "epoch bigint")
    assert S.filter_time_range(df, start, finish).count() == kept


def body_entries(spark, body, trim=True):
    df = spark.createDataFrame([(1, "1.1.1.1", body)], "request_id bigint, client_ip string, body string")
    row = S.shred_request_body(df, trim).first()
    return row and [tuple(e) for e in row["entries"]]


def test_body_lines(spark):
    body = "Host: a.b\r\nno colon here\nReferer: http://x:80/\n\n User-Agent : UA \nHost: c"
    assert body_entries(spark, body) == [
        ("Referer", "http://x:80/", 2),
        ("User-Agent", "UA", 4),
        ("Host", "c", 5),
    ]


def test_body_untrimmed(spark):
    assert body_entries(spark, "A: 1\nB:2", trim=False) == [("A", " 1", 0), ("B", "2", 1)]


def test_empty_body_is_dropped(spark):
    assert body_entries(spark, "") is None


GOLDEN = {
    1: ("Mozilla/5.0 (iPhone; CPU iPhone OS 7_0 like Mac OS X) (compatible; bingbot/2.0; +http://b)"),
    2: "Mozilla/5.0 (Windows NT 6.1; WOW64) Chrome/33.0.1750.154 Safari/537.36",
    3: "Mozilla/5.0 (Windows NT 5.1) Chrome/49.0.2623.112 Safari/537.36 OPR/36.0.2130.80",
    4: "Mediapartners-Google",
    5: "Java/1.8.0_121",
    6: "Mozilla/5.0 (Linux; Android 4.4.2) Chrome/59.0.3071.125 Safari/537.36",
    7: "Mediapartners-Google",
    8: "Mozilla/5.0 (Windows NT 6.1; WOW64) Chrome/56.0.1750.154 Safari/537.36",
    9: "Mozilla/5.0 (compatible; bingbot/2.0; +http://b)",
    10: "Mozilla/5.0 (compatible; bingbot/2.0; +http://b)",
    11: "Mozilla/5.0 (Linux; Android 6.0.1) Chrome/59.0.3071.125 Mobile Safari/537.36",
    12: "Mozilla/5.0 (compatible; bingbot/2.0; +http://b)",
    13: "Mozilla/5.0 (compatible; YandexBot/3.0; +http://y)",
    14: "Mozilla/5.0 (compatible; Googlebot/2.1; +http://g)",
    15: "Mozilla/5.0 (compatible; bingbot/2.0; +http://b)",
    16: "Java/1.8.0_121",
}


def test_golden_log(spark):
    """A sixteen-line log: words leave ten lines, bot signatures five."""
    texts = lines(spark, *(line({"Host": "h", "User-Agent": ua}) for ua in GOLDEN.values()))
    tables = seed_signatures(spark)
    tables["crawler_list"] = spark.createDataFrame(
        [(1, 1, "bingbot", "bingbot", GOLDEN[1]), (2, 1, "bingbot", "bingbot", GOLDEN[9])],
        "id int, class_id int, name string, family_code string, ua_string string",
    )
    golden = load_signatures(tables)
    words = S.parse_log_lines(texts, golden, words_only=True, need_ua=False)
    assert words.count() == 10
    full = S.parse_log_lines(texts, golden)
    assert sorted(r["log_id"] + 1 for r in full.collect()) == [2, 3, 6, 8, 11]
