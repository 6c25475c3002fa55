"""Signatures, first matches, addresses and crawlers."""

import ipaddress

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from headersieve.functions.addresses import ip_version
from headersieve.functions.crawlers import is_bot_family, is_crawler, ua_has_crawler_word
from headersieve.functions.fixed_values import BOT_FAMILIES, CRAWLER_WORDS
from headersieve.operators import match as U
from headersieve.operators.lookup import Lookup, dense_index, lookup_join
from headersieve.plans import queries as Q
from headersieve.sources.fixtures import seed_signatures
from headersieve.sources.signatures import complete, dim_ip_class, load_signatures

CHROME = "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_9_4) Chrome/39.0.2171.71 Safari/537.36"
OPERA = "Mozilla/5.0 (Windows NT 10.0) Chrome/62.0 Safari/537.36 OPR/36.0"


def described(spark, signatures, agent, ip="1.1.1.1", **options):
    df = spark.createDataFrame([(1, agent, ip)], "log_id bigint, user_agent string, ip string")
    return U.parse_user_agents(df, signatures, **options).first()


def test_agent_record(spark, signatures):
    ua = described(spark, signatures, CHROME)["ua"]
    assert ua["ua_string"] == CHROME
    assert (ua["ua_class"], ua["ua_class_code"]) == ("Browser", "browser")
    assert (ua["ua"], ua["ua_version"], ua["ua_version_major"]) == (
        "Chrome 39.0.2171.71", "39.0.2171.71", "39",
    )
    assert (ua["ua_family"], ua["ua_family_code"]) == ("Chrome", "chrome")
    assert (ua["ua_family_vendor"], ua["ua_engine"]) == ("Google Inc.", "WebKit/Blink")
    assert ua["ua_family_info_url"].endswith("/ua-list/browser-detail?browser=Chrome")
    assert (ua["os"], ua["os_code"], ua["os_family_code"]) == ("OS X", "osx", "osx")
    assert ua["device_class_code"] == "desktop"


def test_lower_sequence_decides(spark, signatures):
    assert described(spark, signatures, OPERA)["ua"]["ua_family_code"] == "opera"


def test_crawler_record(spark, signatures):
    ua = described(spark, signatures, "Mozilla/5.0 (compatible; bingbot/2.0)")["ua"]
    assert (ua["ua_class"], ua["ua_class_code"]) == ("Crawler", "crawler")
    assert (ua["ua"], ua["ua_version"], ua["ua_version_major"]) == ("bingbot 2.0", "2.0", "2")
    assert ua["ua_family_info_url"].endswith("bot-detail?bot=bingbot#id1")
    assert ua["crawler_category_code"] == "search_engine_bot"
    assert ua["crawler_respect_robotstxt"] == "yes"


def test_unknown_and_empty_agents(spark, signatures):
    ua = described(spark, signatures, "Nobody")["ua"]
    assert (ua["ua_class_code"], ua["ua_family_code"], ua["ua"]) == ("unrecognized", "", "")
    assert set(described(spark, signatures, "")["ua"].asDict().values()) == {""}


def test_strategies_agree(spark, signatures, sf_dir):
    agents = Q._agents(spark, sf_dir)
    inline = U.parse_user_agents(agents, signatures, "inline")
    distinct = U.parse_user_agents(agents, signatures, "distinct")
    assert inline.count() == agents.count()
    assert inline.exceptAll(distinct).isEmpty() and distinct.exceptAll(inline).isEmpty()


def test_patterns_in_blocks_agree(spark, sf_dir):
    """More patterns than are tried in place are found by their index."""
    tables = seed_signatures(spark)
    agents = Q._agents(spark, sf_dir)
    whole = U.parse_user_agents(agents, load_signatures(tables))
    blocked = load_signatures(tables, block=2)
    assert blocked.clients.patterns is None
    matched = U.match_rules(
        agents.select("user_agent").distinct(), blocked.clients, F.col("user_agent"), "hit"
    )
    expected = whole.filter("ua.ua_class_code not in ('', 'crawler', 'unrecognized')")
    found = {r["user_agent"]: r["hit"]["version"] for r in matched.collect() if r["hit"]}
    assert found == {r[0]: r[1] for r in expected.select("user_agent", "ua.ua_version").collect()}


def test_unreadable_patterns_are_reported_not_fatal(spark):
    tables = seed_signatures(spark)
    bad = spark.createDataFrame([(1, 5, "/chrome(/si")], "client_id int, sequence int, regstring string")
    tables["client_regex"] = tables["client_regex"].unionByName(bad)
    loaded = load_signatures(tables)
    assert [r["kind"] for r in loaded.rejected_patterns(spark).collect()] == ["client"]
    assert described(spark, loaded, CHROME)["ua"]["ua_family_code"] == "chrome"


def test_unreadable_patterns_are_reported_at_any_size(spark):
    tables = seed_signatures(spark)
    bad = spark.createDataFrame([(1, 5, "/chrome(/si")], "client_id int, sequence int, regstring string")
    tables["client_regex"] = tables["client_regex"].unionByName(bad)
    reported = [load_signatures(tables, block=b).rejected_patterns(spark).collect() for b in (2, 2000)]
    assert reported[0] == reported[1] and len(reported[0]) == 1


def test_pattern_without_group_has_no_version(spark):
    tables = seed_signatures(spark)
    tables["client_regex"] = spark.sql("SELECT 1 AS client_id, 1 AS sequence, '/CHROME/si' AS regstring")
    ua = described(spark, load_signatures(tables), CHROME)["ua"]
    assert (ua["ua"], ua["ua_version"], ua["ua_version_major"]) == ("Chrome", "", "")


def test_repeated_ip_takes_the_highest_sequence(spark):
    found = {r[0]: r[1] for r in dim_ip_class(seed_signatures(spark)).collect()}
    assert found == {"10.8.0.7": "crawler", "10.6.5.7": "cloud", "10.13.9.7": "crawler"}


@pytest.mark.parametrize(
    ("ip", "version", "code"),
    [
        ("10.8.0.7", "v4", "crawler"),
        ("10.6.5.7", "v4", "cloud"),
        ("9.9.9.9", "v4", ""),
        ("2001:db8::1", "", ""),
        ("junk", "", ""),
        ("", "", ""),
    ],
)
def test_classify_ip(spark, signatures, ip, version, code):
    address = described(spark, signatures, "", ip)["address"]
    assert tuple(address) == (ip, version, code)


def _expected_version(text):
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return ""
    if "%" in text:
        return ""
    return "v4" if address.version == 4 or address.ipv4_mapped is not None else "v6"


_HEX = st.integers(0, 0xFFFF).map(lambda n: f"{n:x}")
_V4 = st.lists(st.integers(0, 300), min_size=3, max_size=5).map(lambda p: ".".join(map(str, p)))
_TEXTS = st.one_of(
    _V4,
    st.ip_addresses().map(str),
    st.ip_addresses(v=6).map(lambda a: a.exploded),
    _V4.map(lambda a: f"::ffff:{a}"),
    st.lists(_HEX, min_size=6, max_size=9).map(":".join),
    st.lists(st.sampled_from(["0", "ffff", "1", "", "12345", "1.2.3.4"]), min_size=2, max_size=9).map(":".join),
)


@settings(max_examples=4, deadline=None)
@given(st.lists(_TEXTS, min_size=150, max_size=150))
def test_ip_version_against_the_standard_library(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    rows = df.select("ip", ip_version(F.col("ip")).alias("v")).collect()
    wrong = [(r["ip"], r["v"]) for r in rows if r["v"] != _expected_version(r["ip"])]
    assert wrong == []


@pytest.mark.parametrize(
    ("ip_code", "ua_class", "family", "agent", "full", "words"),
    [
        ("crawler", "browser", "chrome", CHROME, True, False),
        ("", "browser", "chrome", CHROME, False, False),
        ("", "crawler", "abrave", "Abrave v5.5", True, False),
        ("", "browser", "curl", "curl/7", True, False),
        ("", "browser", "chrome", "xSpider", True, True),
        ("", "browser", "chrome", "xSPIDER", False, False),
    ],
)
def test_is_crawler(spark, ip_code, ua_class, family, agent, full, words):
    lit = F.lit
    row = spark.range(1).select(
        is_crawler(lit(agent), lit(ua_class), lit(family), lit(ip_code)).alias("full"),
        is_crawler(lit(agent), words_only=True).alias("words"),
    ).first()
    assert (row["full"], row["words"]) == (full, words)


def test_every_word_and_family_counts(spark):
    assert (len(CRAWLER_WORDS), len(set(BOT_FAMILIES))) == (24, 111)
    words = spark.createDataFrame([(f"a{w}b",) for w in CRAWLER_WORDS], "ua string")
    assert words.filter(ua_has_crawler_word(F.col("ua"))).count() == 24
    families = spark.createDataFrame([(f,) for f in (*BOT_FAMILIES, "chrome")], "f string")
    assert families.filter(is_bot_family(F.col("f"))).count() == 111


def test_missing_signature_table_is_an_error(spark):
    tables = seed_signatures(spark)
    del tables["os_list"]
    with pytest.raises(ValueError, match="os_list"):
        complete(tables)


def test_large_lookup_is_shuffled_and_keeps_every_row(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3000)]
    left = spark.createDataFrame(rows, "log_id bigint, k string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 40)], "name string, v int")
    assert not Lookup.measure(right, "name", max_rows=10).small
    broadcast = lookup_join(left, Lookup.measure(right, "name"), F.col("k"))
    shuffled = lookup_join(left, Lookup(right, "name", False), F.col("k"))
    assert shuffled.count() == 3000
    assert shuffled.exceptAll(broadcast).isEmpty()


def test_dense_index_is_dense_and_ordered(spark):
    names = spark.range(5000).select(F.concat(F.lit("n"), F.col("id")).alias("name")).repartition(7)
    numbered = [r["idx"] for r in dense_index(names, [F.col("name")], "idx").orderBy("name").collect()]
    assert numbered == list(range(5000))
