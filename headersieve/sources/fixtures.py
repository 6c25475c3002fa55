"""Header logs derived from the ``events`` table, with signatures to match.

The SQL texts here run unchanged in Spark and DuckDB and give the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headersieve.functions.headers import once
from headersieve.sources.signatures import TABLES, complete

HEADER_LOG_LINES = """
SELECT event_id AS log_id,
       1704067200 + event_id AS epoch,
       '10.' || CAST(user_id % 16 AS STRING) || '.' || CAST(event_id % 64 AS STRING) || '.7' AS ip,
       CAST(1704067200 + event_id AS STRING) || ',10.' || CAST(user_id % 16 AS STRING) || '.' || CAST(event_id % 64 AS STRING) || '.7,' || chr(39) || '{' ||
       CASE event_id % 5
         WHEN 0 THEN '"Host":"h' || CAST(user_id % 7 AS STRING) || '.example.com","Connection":"keep-alive","Accept":"*' || chr(92) || '/*","User-Agent":"' || u || '","Accept-Encoding":"gzip, deflate"'
         WHEN 1 THEN '"Cache-Control":"no-cache","Connection":"Keep-Alive","Accept":"text' || chr(92) || '/html","Accept-Encoding":"gzip","From":"a(at)example.com","Host":"h.example.com","User-Agent":"' || u || '"'
         WHEN 2 THEN '"User-Agent":"' || u || '","Host":"h.example.com","Accept":"text' || chr(92) || '/html","Connection":"keep-alive"'
         WHEN 3 THEN '"accept":"*' || chr(92) || '/*","user-agent":"' || u || '","host":"h.example.com"'
         ELSE '"Host":"h.example.com","Upgrade-Insecure-Requests":"1","Accept":"*' || chr(92) || '/*","X-K":"' || event_type || '"'
       END || '}' || chr(39) AS line
FROM (SELECT event_id, user_id, event_type,
        CASE user_id % 6
          WHEN 0 THEN 'Mozilla' || chr(92) || '/5.0 (Windows NT 10.0) Chrome' || chr(92) || '/6' || CAST(event_id % 3 AS STRING) || '.0.1 Safari' || chr(92) || '/537.36'
          WHEN 1 THEN 'Mozilla' || chr(92) || '/5.0 (X11; Linux) Firefox' || chr(92) || '/5' || CAST(event_id % 4 AS STRING) || '.0'
          WHEN 2 THEN 'Mozilla' || chr(92) || '/5.0 (Macintosh) Chrome' || chr(92) || '/62.0 Safari' || chr(92) || '/537.36 OPR' || chr(92) || '/36.0'
          WHEN 3 THEN 'Java' || chr(92) || '/1.8.0_121'
          WHEN 4 THEN 'Mozilla' || chr(92) || '/5.0 (compatible; bingbot' || chr(92) || '/2.0)'
          ELSE 'UnknownAgent' || chr(92) || '/1.0'
        END AS u FROM events) e
"""

# The same lines with one in about eleven spoiled, each kind in its own way.
MESSY_LOG_LINES = """
SELECT log_id,
       CASE log_id % 101
         WHEN 3 THEN substr(line, 1, 10)
         WHEN 13 THEN substr(line, 1, 10) || ',,' || substr(line, 12)
         WHEN 23 THEN 'x' || substr(line, 2)
         WHEN 33 THEN '0' || substr(line, 2)
         WHEN 43 THEN substr(line, 1, 10) || ';10.0.0.1,{}'
         WHEN 53 THEN substr(line, 1, 10) || ',10.0.0.1,'
         WHEN 63 THEN substr(line, 1, 10) || ',10.0.0.1,{"Host":"h"}'
         WHEN 73 THEN substr(line, 1, 10) || ',10.0.0.1,' || chr(39) || '["Host"' || chr(39)
         WHEN 83 THEN substr(line, 1, 10) || ',10.0.0.1,' || chr(39) || '{"Host":"h","User-Agent":""}' || chr(39)
         ELSE line
       END AS line
FROM header_log_lines
"""

# Signature seeds: small stand-ins for a signature database.
SIGNATURE_SEEDS: dict[str, str] = {
    "client_class": "SELECT * FROM (VALUES (1,'Browser','browser'),(2,'Library','library')) AS t(id, client_classification, client_classification_code)",
    "client_list": "SELECT * FROM (VALUES (1,1,'Chrome','chrome','WebKit/Blink','Google Inc.','google_inc','62','http://home.example/chrome','chrome.png','chrome_big.png','http://vendor.example/google'),(2,1,'Firefox','firefox','Gecko','Mozilla Foundation','mozilla_foundation','57','http://home.example/firefox','firefox.png','','http://vendor.example/mozilla'),(3,1,'Opera','opera','WebKit/Blink','Opera Software ASA','opera_software_asa','49','http://home.example/opera','opera.png','opera_big.png',''),(4,2,'Java','java','','Oracle','oracle','','','java.png','java_big.png','http://vendor.example/oracle')) AS t(id, class_id, name, name_code, engine, vendor, vendor_code, uptodate_current_version, homepage, icon, icon_big, vendor_homepage)",
    "client_regex": "SELECT * FROM (VALUES (3,10,'/opr/([0-9.]+)/si'),(1,20,'/chrome/([0-9.]+)/si'),(2,30,'/firefox/([0-9.]+)/si'),(4,40,'/java/([0-9._]+)/si')) AS t(client_id, sequence, regstring)",
    "os_list": "SELECT * FROM (VALUES (1,'Windows','windows','Windows 10','windows_10','http://os.example/windows','windows.png','windows_big.png','Microsoft','microsoft','http://vendor.example/microsoft'),(2,'Linux','linux','Linux','linux','http://os.example/linux','linux.png','','','',''),(3,'OS X','osx','OS X','osx','http://os.example/osx','osx.png','osx_big.png','Apple','apple','http://vendor.example/apple')) AS t(id, family, family_code, name, name_code, homepage, icon, icon_big, vendor, vendor_code, vendor_homepage)",
    "os_regex": "SELECT * FROM (VALUES (1,10,'/windows nt 10[.]0/si'),(2,20,'/linux/si'),(3,30,'/macintosh/si')) AS t(os_id, sequence, regstring)",
    "deviceclass_list": "SELECT * FROM (VALUES (1,'Smartphone','smartphone','phone.png','phone_big.png'),(2,'Desktop','desktop','desktop.png','desktop_big.png')) AS t(id, name, name_code, icon, icon_big)",
    "deviceclass_regex": "SELECT * FROM (VALUES (1,10,'/mobile/si'),(2,20,'/windows|linux|macintosh/si')) AS t(deviceclass_id, sequence, regstring)",
    "crawler_class": "SELECT * FROM (VALUES (1,'Search engine bot','search_engine_bot')) AS t(id, crawler_classification, crawler_classification_code)",
    "crawler_list": "SELECT * FROM (VALUES (1,1,'bingbot','2.0','bingbot','bingbot','Mozilla/5.0 (compatible; bingbot/2.0)','2017-08-18 21:00:00','yes','http://family.example/bingbot','bingbot.png','Microsoft','microsoft','http://vendor.example/microsoft')) AS t(id, class_id, name, ver, family, family_code, ua_string, last_seen, respect_robotstxt, family_homepage, family_icon, vendor, vendor_code, vendor_homepage)",
    "ip_class": "SELECT * FROM (VALUES (1,'Crawler','crawler'),(2,'Cloud','cloud')) AS t(id, ip_classification, ip_classification_code)",
    "ip_list": "SELECT * FROM (VALUES ('10.8.0.7',2,CAST(NULL AS INT),1),('10.8.0.7',1,1,2),('10.6.5.7',2,CAST(NULL AS INT),3),('10.13.9.7',1,1,4)) AS t(ip, class_id, crawler_id, sequence)",
}

# Signature tables grown from the given tables, so that the dimension joins have
# work that grows: suppliers stand for clients, customers for systems and
# devices, parts, orders and events for the lists that refer to them.
GROWN_SIGNATURES: dict[str, str] = {
    "client_class": "SELECT CAST(n_nationkey AS INT) AS id, n_name AS client_classification, lower(n_name) AS client_classification_code FROM nation",
    "client_list": "SELECT CAST(s_suppkey AS INT) AS id, CAST(s_nationkey AS INT) AS class_id, s_name AS name, lower(s_name) AS name_code, 'http://' || lower(s_name) AS homepage FROM supplier",
    "client_regex": "SELECT CAST(1 + p_partkey % 150 AS INT) AS client_id, CAST(p_partkey AS INT) AS sequence, '/' || p_name || '/([0-9.]+)/si' AS regstring FROM part",
    "os_list": "SELECT CAST(c_custkey AS INT) AS id, c_mktsegment AS family, lower(c_mktsegment) AS family_code, c_name AS name, lower(c_name) AS name_code FROM customer",
    "os_regex": "SELECT CAST(o_custkey AS INT) AS os_id, CAST(o_orderkey AS INT) AS sequence, '/' || o_orderstatus || '/si' AS regstring FROM orders",
    "deviceclass_list": "SELECT CAST(c_custkey AS INT) AS id, c_name AS name, lower(c_name) AS name_code FROM customer",
    "deviceclass_regex": "SELECT CAST(o_custkey AS INT) AS deviceclass_id, CAST(o_orderkey AS INT) AS sequence, o_orderpriority AS regstring FROM orders",
    "crawler_class": "SELECT CAST(r_regionkey AS INT) AS id, r_name AS crawler_classification, lower(r_name) AS crawler_classification_code FROM region",
    "crawler_list": "SELECT CAST(event_id AS INT) AS id, CAST(event_id % 7 AS INT) AS class_id, event_type AS name, CAST(event_id % 9 AS STRING) || '.0' AS ver, event_type AS family, event_type AS family_code, 'bot/' || CAST(user_id AS STRING) AS ua_string FROM events",
    "ip_class": "SELECT CAST(r_regionkey AS INT) AS id, r_name AS ip_classification, lower(r_name) AS ip_classification_code FROM region",
    "ip_list": "SELECT '10.' || CAST(user_id % 16 AS STRING) || '.' || CAST(event_id % 64 AS STRING) || '.7' AS ip, CAST(event_id % 6 AS INT) AS class_id, CAST(event_id % 50 AS INT) AS crawler_id, CAST(event_id AS INT) AS sequence FROM events",
}

# Agents of many makes, each text once with the lowest line number it comes from.
GROWN_AGENTS = """
SELECT user_agent, min(l_linenumber) AS first_line FROM (
  SELECT l_linenumber, 'Mozilla/5.0 (Os-' || CAST(l_partkey % 97 AS STRING) || '; ' ||
    CASE l_partkey % 3 WHEN 0 THEN 'Mobile' ELSE 'Desk' END || ') ' ||
    CASE l_partkey % 4 WHEN 0 THEN upper(p_name) ELSE p_name END || CAST(p_partkey AS STRING) || '/' ||
    CAST(l_linenumber AS STRING) || '.' || CAST(l_partkey % 10 AS STRING) AS user_agent
  FROM (SELECT * FROM lineitem) l
    JOIN (SELECT p_partkey, replace(p_name, ' ', '-') AS p_name FROM part) p ON p_partkey = l_partkey) a
GROUP BY user_agent
"""

# Signatures for them: a pattern for every part, of different kinds and in an order unlike that of the
# parts. Some match all parts of a name, and some hold no text that every match needs.
PATTERN_SIGNATURES: dict[str, str] = {
    "client_class": "SELECT CAST(r_regionkey AS INT) AS id, r_name AS client_classification, lower(r_name) AS client_classification_code FROM region",
    "client_list": "SELECT CAST(p_partkey AS INT) AS id, CAST(p_partkey % 5 AS INT) AS class_id, p_name AS name, lower(p_name) AS name_code FROM part",
    "client_regex": """SELECT CAST(p_partkey AS INT) AS client_id, CAST(p_partkey * 7919 % 1000003 AS INT) AS sequence,
      '/' || CASE
        WHEN p_partkey % 50 = 3 THEN '(?:none|' || p_name || CAST(p_partkey AS STRING) || ')/([0-9.]+)'
        WHEN p_partkey % 5 = 0 THEN p_name || CAST(p_partkey AS STRING) || '/([0-9.]+)'
        WHEN p_partkey % 5 = 1 THEN ' ' || upper(p_name) || CAST(p_partkey AS STRING) || '[/]([0-9]+)'
        WHEN p_partkey % 5 = 2 THEN p_name || CAST(p_partkey AS STRING) || '/([2-5])|' || p_name || CAST(p_partkey AS STRING) || '/6[.0-9]*'
        WHEN p_partkey % 5 = 3 THEN '(?:' || p_name || ')' || CAST(p_partkey AS STRING) || 'x?/([0-9.]+)'
        ELSE p_name || '[0-9]*' || CAST(p_partkey % 10 AS STRING) || '/([0-9.]+)' END || '/si' AS regstring
      FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS p_name FROM part) p""",
    "os_list": "SELECT CAST(s_suppkey AS INT) AS id, s_name AS family, lower(s_name) AS family_code, s_name AS name, lower(s_name) AS name_code FROM supplier",
    "os_regex": "SELECT CAST(s_suppkey AS INT) AS os_id, CAST(1000 - s_suppkey AS INT) AS sequence, '/os-' || CAST(s_suppkey AS STRING) || '/si' AS regstring FROM supplier",
}

# The classes of the fixed weights; class number k is the place.
FIXED_CLASSES = ("chrome", "firefox", "opera")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _from_files(text: str, sf_dir: str, *tables: str) -> str:
    """Point the named tables of a query at their parquet files."""
    for name in tables:
        text = re.sub(rf"\bFROM {name}\b", f"FROM parquet.`{sf_dir}/{name}.parquet`", text)
    return text


def _lines(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Lines made from events, each put together once.

    A small events file is read by fewer tasks than there are threads; its
    narrow rows are spread before they are blown up into lines.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = events.select("event_id", "user_id", "event_type")
    wanted = spark.sparkContext.defaultParallelism
    if events.rdd.getNumPartitions() < wanted:
        events = events.repartition(wanted, "event_id")
    view = "headersieve_events"
    events.createOrReplaceTempView(view)
    lines = spark.sql(text.replace("FROM events", f"FROM {view}"))
    return once(lines.withColumnRenamed("line", "text"), "line", F.col("text")).drop("text")


def header_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``log_id, epoch, ip, line``: one log line per event."""
    return _lines(spark, sf_dir, HEADER_LOG_LINES)


def messy_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``log_id, line``: the same lines, some of them spoiled."""
    spoiled = MESSY_LOG_LINES.replace("header_log_lines", f"({HEADER_LOG_LINES})")
    return _lines(spark, sf_dir, spoiled)


def seed_signatures(spark: SparkSession) -> dict[str, DataFrame]:
    return complete({name: spark.sql(SIGNATURE_SEEDS[name]) for name in TABLES})


def grown_signatures(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The signature tables grown from the given tables."""
    names = ("nation", "supplier", "part", "customer", "orders", "region", "events")
    return complete(
        {n: spark.sql(_from_files(text, sf_dir, *names)) for n, text in GROWN_SIGNATURES.items()}
    )


def grown_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_agent, first_line``: distinct agents for ``pattern_signatures``."""
    return spark.sql(_from_files(GROWN_AGENTS, sf_dir, "lineitem", "part"))


def pattern_signatures(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Signature tables with a pattern for every part; devices and crawlers are the seeds."""
    grown = {n: _from_files(t, sf_dir, "region", "part", "supplier") for n, t in PATTERN_SIGNATURES.items()}
    return complete({name: spark.sql(grown.get(name, SIGNATURE_SEEDS[name])) for name in TABLES})


def request_bodies(headers: DataFrame) -> DataFrame:
    """Requests from shredded lines: ``Name: value`` lines in header order.

    Every fiftieth request has no client address.
    """
    lines = F.transform(F.col("entries"), lambda e: F.concat(e["k"], F.lit(": "), e["v"]))
    return headers.select(
        F.col("log_id").alias("request_id"),
        F.when(F.col("log_id") % 50 == 4, "").otherwise(F.col("ip")).alias("client_ip"),
        F.array_join(lines, "\n").alias("body"),
    )


def fixed_coefficients(spark: SparkSession, width: int, scale: int = 1) -> DataFrame:
    """Weights by a rule, as ``(class, column, weight)``; column -1 is the intercept.

    A scale of 10 drives the probabilities apart, a negative one turns them round.
    """
    classes = F.array(*map(F.lit, FIXED_CLASSES))
    column, k = F.col("column"), F.col("k")
    weight = F.when(column < 0, k - 1).otherwise((column * 7 + k * 13) % 11 - 5) / F.lit(10.0)
    cells = spark.range(-1, width).select(
        F.col("id").cast("int").alias("column"), F.posexplode(classes).alias("k", "class")
    )
    return cells.select("class", "column", (weight * scale).alias("weight"))
