"""The queries in plain SQL, for comparison by another engine on the same tables.

All queries share one chain of common table expressions; each adds its select.
"""

from __future__ import annotations

from headersieve.functions import fixed_values as V
from headersieve.sources.fixtures import (
    FIXED_CLASSES,
    GROWN_AGENTS,
    GROWN_SIGNATURES,
    HEADER_LOG_LINES,
    MESSY_LOG_LINES,
    PATTERN_SIGNATURES,
    SIGNATURE_SEEDS,
)

EPOCH = 1704067200
# From a hundredth to seven tenths of the time that the events cover.
PERIOD = tuple(
    f"(SELECT {EPOCH} + min(event_id) + (max(event_id) - min(event_id)) * {share} // 100 FROM events)"
    for share in (1, 70)
)
FIRST_N = 1000


def _texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _spellings(values) -> str:
    return _texts([*values, *(v.lower() for v in values)])


def _shred(lines: str, to: str) -> list[tuple[str, str]]:
    """Expressions that take log lines apart, named with the given suffix."""
    return [
        (
            f"parts{to}",
            f"""SELECT log_id, line,
              CASE WHEN rest LIKE '%,%' THEN substr(line, 1, 10) END AS epoch_text,
              CASE WHEN rest LIKE '%,%' THEN split_part(rest, ',', 1) END AS ip,
              CASE WHEN rest LIKE '%,%' THEN substr(rest, length(split_part(rest, ',', 1)) + 2) END AS headers
            FROM (SELECT log_id, line, substr(line, 12) AS rest FROM {lines})""",
        ),
        (
            f"cleaned{to}",
            f"""SELECT *, regexp_replace(regexp_replace(replace(headers, chr(92) || '/', '/'),
                chr(39) || '$', ''), '^' || chr(39), '') AS header_json
            FROM parts{to}""",
        ),
        (
            f"entries{to}",
            f"""SELECT log_id, k, json_extract_string(header_json, '$."' || k || '"') AS v, pos
            FROM (SELECT log_id, header_json, unnest(json_keys(header_json)) AS k,
                    CAST(generate_subscripts(json_keys(header_json), 1) - 1 AS INTEGER) AS pos
                  FROM cleaned{to}
                  WHERE headers LIKE chr(39) || '%' AND json_valid(header_json))""",
        ),
        (
            f"agents{to}",
            f"""SELECT c.log_id, c.ip, try_cast(c.epoch_text AS BIGINT) AS epoch,
              coalesce(max(CASE WHEN k = 'User-Agent' THEN nullif(v, '') END),
                       max(CASE WHEN k = 'user-agent' THEN nullif(v, '') END),
                       max(CASE WHEN k = 'user_agent' THEN nullif(v, '') END), '') AS user_agent,
              count(CASE WHEN k IN ({_texts(V.USER_AGENT_HEADERS)}) THEN 1 END) AS agent_keys
            FROM cleaned{to} c LEFT JOIN entries{to} e USING (log_id) GROUP BY ALL""",
        ),
    ]


_PATTERN = "regexp_replace(regexp_replace(regstring, '/si$', ''), '^/', '')"


def _match(name: str, rules: str, key: str, entry: str) -> tuple[str, str]:
    """The first matching rule of each agent that is not a listed crawler."""
    return (
        name,
        f"""SELECT user_agent, arg_min({key}, sequence) AS id,
          arg_min(regexp_extract(user_agent, pattern, 1, 'i'), sequence) AS version
        FROM (SELECT DISTINCT user_agent FROM agents
              WHERE user_agent <> '' AND user_agent NOT IN (SELECT ua_string FROM crawler_list)) a
          JOIN (SELECT r.*, {_PATTERN} AS pattern FROM {rules} r JOIN {entry} e ON e.id = r.{key}) p
            ON regexp_matches(user_agent, pattern, 'i')
        GROUP BY user_agent""",
    )


def _first_of_many(name: str, rules: str, key: str, entry: str, needed: str) -> tuple[str, str]:
    """The first matching rule of each grown agent; a text that all its matches hold is looked for first."""
    return (
        name,
        f"""SELECT user_agent, arg_min(id, (sequence, id)) AS id,
          arg_min(regexp_extract(user_agent, pattern, 1, 'i'), (sequence, id)) AS version
        FROM (SELECT user_agent, lower(user_agent) AS low FROM grown_agents) a
          JOIN (SELECT CAST(r.{key} AS BIGINT) AS id, r.sequence, {_PATTERN} AS pattern, lower({needed}) AS needed
                FROM {rules} r JOIN {entry} e ON e.id = r.{key}) p ON contains(low, needed)
        WHERE regexp_matches(user_agent, pattern, 'i') GROUP BY user_agent""",
    )


_CTES: list[tuple[str, str]] = [
    ("header_log_lines", HEADER_LOG_LINES),
    ("messy_log_lines", MESSY_LOG_LINES),
    *SIGNATURE_SEEDS.items(),
    *((f"grown_{name}", text) for name, text in GROWN_SIGNATURES.items()),
    *_shred("header_log_lines", ""),
    _match("client_match", "client_regex", "client_id", "client_list"),
    _match("os_match", "os_regex", "os_id", "os_list"),
    _match("device_match", "deviceclass_regex", "deviceclass_id", "deviceclass_list"),
    (
        "listed_ips",
        """SELECT ip, arg_max(ip_classification_code, sequence) AS code
        FROM ip_list JOIN ip_class ON ip_class.id = ip_list.class_id GROUP BY ip""",
    ),
    (
        "described_agents",
        f"""SELECT a.user_agent AS ua_string,
          CASE WHEN a.user_agent = '' THEN '' WHEN w.id IS NOT NULL THEN '{V.CRAWLER_CLASS[0]}'
               ELSE coalesce(client_classification, '{V.UNRECOGNIZED_CLASS[0]}') END AS ua_class,
          CASE WHEN a.user_agent = '' THEN '' WHEN w.id IS NOT NULL THEN '{V.CRAWLER_CLASS[1]}'
               ELSE coalesce(client_classification_code, '{V.UNRECOGNIZED_CLASS[1]}') END AS ua_class_code,
          coalesce(w.ver, cm.version, '') AS ua_version,
          coalesce(w.name, c.name, '') AS name,
          coalesce(w.family, c.name, '') AS ua_family,
          coalesce(w.family_code, c.name_code, '') AS ua_family_code,
          coalesce(w.vendor, c.vendor, '') AS ua_family_vendor,
          coalesce(w.vendor_code, c.vendor_code, '') AS ua_family_vendor_code,
          coalesce(w.vendor_homepage, c.vendor_homepage, '') AS ua_family_vendor_homepage,
          coalesce(w.family_homepage, c.homepage, '') AS ua_family_homepage,
          coalesce(w.family_icon, c.icon, '') AS ua_family_icon, coalesce(c.icon_big, '') AS ua_family_icon_big,
          coalesce(o.homepage, '') AS os_homepage, coalesce(o.icon, '') AS os_icon,
          coalesce(o.icon_big, '') AS os_icon_big, coalesce(o.vendor, '') AS os_family_vendor,
          coalesce(o.vendor_code, '') AS os_family_vendor_code,
          coalesce(o.vendor_homepage, '') AS os_family_vendor_homepage,
          coalesce(d.icon, '') AS device_class_icon, coalesce(d.icon_big, '') AS device_class_icon_big,
          coalesce(c.engine, '') AS ua_engine,
          coalesce(c.uptodate_current_version, '') AS ua_uptodate_current_version,
          coalesce('{V.BOT_INFO_URL}' || w.family || '#id' || CAST(w.id AS STRING),
                   '{V.BROWSER_INFO_URL}' || c.name, '') AS ua_family_info_url,
          coalesce(o.name, '') AS os, coalesce(o.name_code, '') AS os_code,
          coalesce(o.family, '') AS os_family, coalesce(o.family_code, '') AS os_family_code,
          coalesce('{V.OS_INFO_URL}' || o.name, '') AS os_info_url,
          coalesce(d.name, '') AS device_class, coalesce(d.name_code, '') AS device_class_code,
          coalesce('{V.DEVICE_INFO_URL}' || d.name, '') AS device_class_info_url,
          coalesce(w.last_seen, '') AS crawler_last_seen,
          coalesce(wc.crawler_classification, '') AS crawler_category,
          coalesce(wc.crawler_classification_code, '') AS crawler_category_code,
          coalesce(w.respect_robotstxt, '') AS crawler_respect_robotstxt
        FROM (SELECT DISTINCT user_agent FROM agents) a
          LEFT JOIN crawler_list w ON w.ua_string = a.user_agent
          LEFT JOIN crawler_class wc ON wc.id = w.class_id
          LEFT JOIN client_match cm ON cm.user_agent = a.user_agent
          LEFT JOIN client_list c ON c.id = cm.id
          LEFT JOIN client_class cc ON cc.id = c.class_id
          LEFT JOIN os_match om ON om.user_agent = a.user_agent
          LEFT JOIN os_list o ON o.id = om.id
          LEFT JOIN device_match dm ON dm.user_agent = a.user_agent
          LEFT JOIN deviceclass_list d ON d.id = dm.id""",
    ),
    (
        "described",
        f"""SELECT a.log_id, a.ip, a.epoch, d.*, coalesce(l.code, '') AS ip_classification_code,
          regexp_matches(a.user_agent, '{"|".join(w.replace(".", "[.]") for w in V.CRAWLER_WORDS)}')
            AS by_words_only,
          d.ua_family_code IN ({_texts(V.BOT_FAMILIES)}) AS is_bot_family
        FROM agents a JOIN described_agents d ON d.ua_string = a.user_agent
          LEFT JOIN listed_ips l ON l.ip = a.ip""",
    ),
    (
        "flagged",
        """SELECT *, by_words_only OR is_bot_family OR ua_class_code = 'crawler'
          OR ip_classification_code = 'crawler' AS is_crawler FROM described""",
    ),
    (
        "logs",
        "SELECT * FROM flagged WHERE ua_string <> '' AND NOT is_crawler AND ua_family_code <> ''",
    ),
    (
        "trimmed_order",
        f"SELECT log_id, k, pos FROM entries WHERE k IN ({_spellings(V.ORDER_HEADERS)})",
    ),
    (
        "trimmed_values",
        f"SELECT log_id, k, v, k || '=' || v AS feature_name FROM entries WHERE k IN ({_spellings(V.VALUE_HEADERS)})",
    ),
    (
        "pairs",
        """SELECT a.log_id, a.k || ' < ' || b.k AS pair
        FROM trimmed_order a JOIN trimmed_order b ON a.log_id = b.log_id AND a.pos < b.pos""",
    ),
    ("order_headers", f"SELECT unnest([{_texts(V.ORDER_HEADERS)}]) AS h"),
    (
        "order_slots",
        f"""SELECT pair, CAST(row_number() OVER (ORDER BY pair) - 1 AS INTEGER) AS slot
        FROM (SELECT a.h || ' < ' || b.h AS pair FROM order_headers a JOIN order_headers b ON a.h <> b.h)
        WHERE pair NOT IN ({_texts(f"{a} < {b}" for a, b in V.PAIRS_WITHOUT_SLOT)})""",
    ),
    (
        "order_cells",
        "SELECT DISTINCT log_id, coalesce(slot, 0) AS slot FROM pairs LEFT JOIN order_slots USING (pair)",
    ),
    (
        "vocabulary",
        """SELECT feature_name, CAST(row_number() OVER (ORDER BY feature_name) - 1 AS INTEGER) AS idx
        FROM (SELECT DISTINCT feature_name FROM trimmed_values)""",
    ),
    (
        "cells",
        """SELECT log_id, slot AS position FROM order_cells
        UNION SELECT log_id, 49 + idx FROM trimmed_values JOIN vocabulary USING (feature_name)""",
    ),
    (
        "sample",
        f"""SELECT log_id, epoch, ua_family_code,
          row_number() OVER (ORDER BY epoch DESC, log_id DESC) - 1 AS row
        FROM logs ORDER BY epoch DESC, log_id DESC LIMIT {V.TRAINING_SAMPLE}""",
    ),
    (
        "sample_vocabulary",
        """SELECT feature_name, CAST(row_number() OVER (ORDER BY feature_name) - 1 AS INTEGER) AS idx
        FROM (SELECT DISTINCT feature_name FROM trimmed_values JOIN sample USING (log_id))""",
    ),
    (
        "sample_cells",
        """SELECT log_id, slot AS position FROM order_cells JOIN sample USING (log_id)
        UNION SELECT log_id, 49 + idx FROM trimmed_values JOIN sample USING (log_id)
          JOIN sample_vocabulary USING (feature_name)""",
    ),
    (
        "classes",
        "SELECT * FROM (VALUES "
        + ", ".join(f"({k}, '{name}')" for k, name in enumerate(FIXED_CLASSES))
        + ") AS t(k, class)",
    ),
    ("width", "SELECT 49 + count(*) AS width FROM vocabulary"),
    (
        "margins",
        """SELECT log_id, class, k,
          CAST(k - 1 + sum((position * 7 + k * 13) % 11 - 5) AS DOUBLE) / 10 AS margin
        FROM cells JOIN classes ON true GROUP BY log_id, class, k""",
    ),
    (
        "scores",
        """SELECT log_id, class, round(p / sum(p) OVER (PARTITION BY log_id), 5) AS prob
        FROM (SELECT log_id, class, 1 / (1 + exp(-margin)) AS p FROM margins)""",
    ),
    (
        "sharp_scores",
        """SELECT log_id, class, round(p / sum(p) OVER (PARTITION BY log_id), 5) AS prob
        FROM (SELECT log_id, class, 1 / (1 + exp(-10 * margin)) AS p FROM margins)""",
    ),
    (
        "opposite_scores",
        """SELECT log_id, class, round(p / sum(p) OVER (PARTITION BY log_id), 5) AS prob
        FROM (SELECT log_id, class, 1 / (1 + exp(10 * margin)) AS p FROM margins)""",
    ),
    ("families", "SELECT DISTINCT ua_family_code FROM logs"),
    (
        "false_families",
        """SELECT ua_family_code AS original, coalesce(lead(ua_family_code) OVER (ORDER BY ua_family_code),
            first_value(ua_family_code) OVER (ORDER BY ua_family_code)) AS false_family
        FROM families""",
    ),
    (
        "judged",
        f"""SELECT sample, CASE
            WHEN log_id NOT IN (SELECT log_id FROM entries WHERE k = 'User-Agent' AND v <> '')
              THEN '{V.VERDICT_UNKNOWN}'
            WHEN coalesce(prob, 0) > {V.HUMAN_THRESHOLD} THEN '{V.VERDICT_HUMAN}'
            ELSE '{V.VERDICT_BOT}' END AS verdict
        FROM (SELECT 'humans' AS sample, log_id, ua_family_code AS family FROM logs
              UNION ALL SELECT 'bots', log_id, false_family FROM logs
                JOIN false_families ON original = ua_family_code) s
          LEFT JOIN sharp_scores USING (log_id) WHERE class = family OR class IS NULL""",
    ),
    (
        "requests",
        """SELECT log_id AS request_id, CASE WHEN log_id % 50 = 4 THEN '' ELSE ip END AS client_ip
        FROM cleaned""",
    ),
    (
        "verdicts",
        f"""SELECT request_id, client_ip, ua_string AS user_agent, ua_family_code,
          CASE WHEN ua_string = '' AND client_ip = '' THEN '{V.VERDICT_UNKNOWN}'
               WHEN by_words_only OR is_bot_family OR ua_class_code = 'crawler'
                 OR (client_ip <> '' AND ip_classification_code = 'crawler') THEN '{V.VERDICT_CRAWLER}'
               WHEN coalesce(s.prob, 0) > {V.HUMAN_THRESHOLD} THEN '{V.VERDICT_HUMAN}'
               ELSE '{V.VERDICT_BOT}' END AS verdict,
          CASE WHEN ua_string = '' AND client_ip = '' THEN '{V.VERDICT_UNKNOWN}'
               WHEN by_words_only OR is_bot_family OR ua_class_code = 'crawler'
                 OR (client_ip <> '' AND ip_classification_code = 'crawler') THEN '{V.VERDICT_CRAWLER}'
               WHEN coalesce(t.prob, 0) > {V.HUMAN_THRESHOLD} THEN '{V.VERDICT_HUMAN}'
               ELSE '{V.VERDICT_BOT}' END AS opposite_verdict
        FROM requests r JOIN described d ON d.log_id = r.request_id
          LEFT JOIN sharp_scores s ON s.log_id = r.request_id AND s.class = ua_family_code
          LEFT JOIN opposite_scores t ON t.log_id = r.request_id AND t.class = ua_family_code""",
    ),
    (
        "addresses",
        """SELECT log_id, CASE log_id % 11
            WHEN 0 THEN '::ffff:' || ip
            WHEN 1 THEN '2001:db8::' || lower(to_hex(log_id))
            WHEN 2 THEN ip || '.1'
            WHEN 3 THEN '999.' || ip
            WHEN 4 THEN 'fe80:0:0:0:1:2:3:' || lower(to_hex(log_id))
            WHEN 5 THEN ''
            WHEN 6 THEN '2001::db8::' || lower(to_hex(log_id))
            ELSE ip END AS ip, log_id % 11 AS kind
        FROM header_log_lines""",
    ),
    (
        "versioned_addresses",
        """SELECT log_id, ip, CASE WHEN kind IN (0, 7, 8, 9, 10) THEN 'v4'
            WHEN kind IN (1, 4) AND length(split_part(ip, ':', -1)) <= 4 THEN 'v6'
            ELSE '' END AS ip_version
        FROM addresses""",
    ),
    *_shred("messy_log_lines", "_messy"),
    *((f"many_{name}", text) for name, text in PATTERN_SIGNATURES.items()),
    ("grown_agents", GROWN_AGENTS),
    _first_of_many("many_client_match", "many_client_regex", "client_id", "many_client_list", "replace(e.name, ' ', '-')"),
    _first_of_many("many_os_match", "many_os_regex", "os_id", "many_os_list", "'os-'"),
]


def _sql(select: str) -> str:
    chain = ",\n".join(f"{name} AS ({body.strip()})" for name, body in _CTES)
    own = ",\n" + select.strip().removeprefix("WITH ") if select.strip().startswith("WITH ") else "\n" + select.strip()
    return f"WITH {chain}{own}"


def _codes(label: str, source: str) -> str:
    """Labels numbered by first appearance."""
    return f"""SELECT text, CAST(row_number() OVER (ORDER BY epoch, log_id, text) - 1 AS INTEGER) AS int_code
      FROM (SELECT {label} AS text, arg_min(epoch, epoch) AS epoch, min(log_id) AS log_id FROM {source} GROUP BY 1)"""


_FULL_VERSION = "ua_family_code || ' ' || ua_version"
_LOG_COLUMNS = f"""log_id, ip, ua_string AS user_agent, ua_family_code, {_FULL_VERSION} AS ua_version,
  ua_class_code, device_class_code, os_family_code, os_code"""
_GROWN_PATTERN = f"'(?i)' || {_PATTERN} AS pattern"

_REJECTED = f"""SELECT p.log_id, CASE
            WHEN p.headers IS NULL THEN 'malformed_line'
            WHEN p.ip = '' THEN 'empty_ip'
            WHEN a.epoch IS NULL THEN 'bad_timestamp'
            WHEN a.epoch < {PERIOD[0]} THEN 'outside_time_range'
            WHEN len(string_split(line, ',')) < 3 THEN 'too_few_parts'
            WHEN headers = '' THEN 'empty_headers'
            WHEN headers NOT LIKE chr(39) || '%' THEN 'unquoted_headers'
            WHEN NOT json_valid(header_json) THEN 'malformed_json'
            WHEN agent_keys = 0 THEN 'no_user_agent_key'
            WHEN user_agent = '' THEN 'empty_user_agent'
            WHEN f.is_crawler THEN 'crawler'
            WHEN f.ua_family_code = '' THEN 'empty_ua_family' END AS reason
        FROM cleaned_messy p JOIN agents_messy a USING (log_id) LEFT JOIN flagged f USING (log_id)"""

_SELECTS: dict[str, str] = {
    "count_lines": f"""WITH rejected AS ({_REJECTED})
        SELECT coalesce(reason, 'accepted') AS reason, count(*) AS lines FROM rejected GROUP BY 1
        UNION ALL SELECT 'read', count(*) FROM rejected""",
    "read_header_logs": "SELECT line FROM header_log_lines",
    "latest_log_file": """SELECT count(*) AS lines, min(epoch) AS first, max(epoch) AS last
        FROM header_log_lines WHERE epoch // 3600 = (SELECT max(epoch // 3600) FROM header_log_lines)""",
    "pending_files": """SELECT DISTINCT 'log-' || CAST(epoch // 600 AS STRING) || '.gz' AS file_name
        FROM header_log_lines
        WHERE epoch // 600 NOT IN (SELECT epoch // 600 FROM header_log_lines WHERE ip LIKE '%.0.7')""",
    "ingest_pending": """SELECT ua_family_code, count(*) AS logs, count(DISTINCT log_id) AS ids,
          CAST(0 AS INTEGER) AS loaded_again FROM logs GROUP BY 1""",
    "write_logs": """SELECT CAST(CAST(make_timestamp(epoch * 1000000) AS DATE) AS STRING) AS log_date,
          count(*) AS logs FROM logs GROUP BY 1""",
    "preview_raw_headers": "SELECT log_id, header_json FROM cleaned ORDER BY log_id LIMIT 10",
    "load_signatures": """SELECT 'clients' AS lookup, count(*) AS entries FROM grown_client_regex r
          JOIN grown_client_list l ON l.id = r.client_id JOIN grown_client_class c ON c.id = l.class_id
        UNION ALL SELECT 'systems', count(*) FROM grown_os_regex r JOIN grown_os_list l ON l.id = r.os_id
        UNION ALL SELECT 'devices', count(*) FROM grown_deviceclass_regex r
          JOIN grown_deviceclass_list l ON l.id = r.deviceclass_id
        UNION ALL SELECT 'crawlers', count(DISTINCT ua_string) FROM grown_crawler_list
        UNION ALL SELECT 'addresses', count(DISTINCT ip) FROM grown_ip_list l
          JOIN grown_ip_class c ON c.id = l.class_id""",
    "save_vocabulary": "SELECT feature_name, idx FROM vocabulary",
    "save_codes": f"""SELECT text, int_code, count(*) AS logs FROM agents
          JOIN ({_codes("user_agent", "agents")}) ON text = user_agent GROUP BY ALL""",
    "write_training_tables": """SELECT log_id, row, CAST(position AS INTEGER) AS column,
          ua_family_code AS name FROM sample_cells JOIN sample USING (log_id)""",
    "save_model": """SELECT class, CAST(c AS INTEGER) AS column,
          CAST(CASE WHEN c < 0 THEN k - 1 ELSE (c * 7 + k * 13) % 11 - 5 END AS DOUBLE) / 10 AS weight,
          CAST(width AS INTEGER) AS width
        FROM width, unnest(range(-1, width)) AS r(c), classes""",
    "write_test_logs": """SELECT log_id AS original_id, ua_family_code AS original_ua_family_code,
          false_family AS ua_family_code, epoch FROM logs JOIN false_families ON original = ua_family_code""",
    "split_log_line": "SELECT log_id, epoch_text, ip, headers FROM parts",
    "reject_reason": _REJECTED,
    "filter_time_range": f"SELECT log_id, epoch FROM agents WHERE epoch BETWEEN {PERIOD[0]} AND {PERIOD[1]}",
    "clean_header_json": "SELECT log_id, header_json FROM cleaned",
    "shred_headers_json": "SELECT log_id, k, v, pos FROM entries",
    "raw_headers_with_crawlers": f"""SELECT log_id, CAST(epoch_text AS BIGINT) AS epoch, ip, header_json
        FROM cleaned WHERE CAST(epoch_text AS BIGINT) BETWEEN {PERIOD[0]} AND {PERIOD[1]}""",
    "shred_request_body": """SELECT request_id, client_ip, user_agent, k, v, pos
        FROM requests JOIN agents ON agents.log_id = request_id JOIN entries ON entries.log_id = request_id""",
    "pick_user_agent": """SELECT log_id, coalesce(nullif(first, ''), nullif(second, ''), '') AS online,
          CASE WHEN first <> '' AND second IS NOT NULL THEN second ELSE coalesce(first, '') END AS legacy,
          coalesce(first, '') AS evaluation
        FROM (SELECT log_id, max(CASE WHEN k = 'User-Agent' THEN v END) AS first,
            CASE log_id % 7 WHEN 3 THEN 'second/2' WHEN 5 THEN ''
              ELSE max(CASE WHEN k = 'user-agent' THEN v END) END AS second
          FROM agents LEFT JOIN entries USING (log_id) GROUP BY log_id)""",
    "trim_order": "SELECT log_id, k AS header, pos FROM trimmed_order",
    "trim_values": "SELECT log_id, k AS header, v AS value FROM trimmed_values",
    "parse_log_lines": f"""SELECT {_LOG_COLUMNS}, epoch, n AS headers, n AS positions
        FROM logs JOIN (SELECT log_id, CAST(count(*) AS INTEGER) AS n FROM entries GROUP BY 1) USING (log_id)""",
    "project_logs": f"""SELECT {_LOG_COLUMNS}, epoch AS timestamp, v AS host, pos AS host_position
        FROM logs JOIN (SELECT log_id, v, pos FROM entries WHERE lower(k) = 'host') USING (log_id)""",
    "dim_client_regex": f"""SELECT class_id, client_id, sequence, {_GROWN_PATTERN}, name, name_code, homepage,
          '' AS icon, '' AS engine, '' AS vendor, '' AS vendor_code, '' AS uptodate_current_version,
          client_classification, client_classification_code
        FROM grown_client_regex r JOIN grown_client_list l ON l.id = r.client_id
          JOIN grown_client_class c ON c.id = l.class_id""",
    "dim_os_regex": f"""SELECT os_id, sequence, {_GROWN_PATTERN}, family, family_code, name, name_code,
          '' AS vendor FROM grown_os_regex r JOIN grown_os_list l ON l.id = r.os_id""",
    "dim_device_regex": f"""SELECT deviceclass_id, sequence, {_GROWN_PATTERN}, name, name_code, '' AS icon
        FROM grown_deviceclass_regex r JOIN grown_deviceclass_list l ON l.id = r.deviceclass_id""",
    "dim_ip_class": """SELECT ip, arg_max(ip_classification_code, sequence) AS ip_classification_code
        FROM grown_ip_list l JOIN grown_ip_class c ON c.id = l.class_id
          LEFT JOIN grown_crawler_list w ON w.id = l.crawler_id
          LEFT JOIN grown_crawler_class wc ON wc.id = w.class_id GROUP BY ip""",
    "dim_crawlers": """SELECT ua_string, w.id AS botid, name, ver, family, family_code, '' AS vendor,
          coalesce(crawler_classification, '') AS crawler_classification,
          coalesce(crawler_classification_code, '') AS crawler_classification_code
        FROM grown_crawler_list w LEFT JOIN grown_crawler_class c ON c.id = w.class_id
        WHERE w.id IN (SELECT max(id) FROM grown_crawler_list GROUP BY ua_string)""",
    "match_crawler_ua": """SELECT log_id, name, ver, family_code, last_seen, crawler_classification_code
        FROM agents LEFT JOIN crawler_list w ON ua_string = user_agent
          LEFT JOIN crawler_class c ON c.id = class_id""",
    "match_client_regex": """SELECT log_id, CAST(m.id AS INTEGER) AS client_id, version,
          name_code AS family_code, client_classification_code AS class_code
        FROM agents LEFT JOIN client_match m USING (user_agent) LEFT JOIN client_list l ON l.id = m.id
          LEFT JOIN client_class c ON c.id = l.class_id""",
    "match_os_regex": """SELECT log_id, name_code AS os_code, family AS os_family
        FROM agents LEFT JOIN os_match m USING (user_agent) LEFT JOIN os_list l ON l.id = m.id""",
    "match_device_regex": """SELECT log_id, name_code AS device_class_code
        FROM agents LEFT JOIN device_match m USING (user_agent)
          LEFT JOIN deviceclass_list l ON l.id = m.id""",
    "match_client_index": "SELECT user_agent, id, version FROM grown_agents LEFT JOIN many_client_match USING (user_agent)",
    "match_os_index": "SELECT user_agent, id, version FROM grown_agents LEFT JOIN many_os_match USING (user_agent)",
    "agent_dictionary": """SELECT user_agent, CAST(NULL AS BIGINT) AS crawler_id, c.id AS client_id, c.version,
          o.id AS os_id, CAST(CASE WHEN user_agent ILIKE '%mobile%' THEN 1 END AS BIGINT) AS device_id,
          CAST(count(*) FILTER (WHERE first_line <= 3) OVER () AS INTEGER) AS first,
          CAST(count(*) FILTER (WHERE first_line > 3) OVER () AS INTEGER) AS rest, CAST(0 AS INTEGER) AS again
        FROM grown_agents LEFT JOIN many_client_match c USING (user_agent)
          LEFT JOIN many_os_match o USING (user_agent)""",
    "ip_version": "SELECT log_id, ip, ip_version FROM versioned_addresses",
    "classify_ip": """SELECT log_id, a.ip, CASE WHEN ip_version = 'v4' THEN 'v4' ELSE '' END AS ip_ver,
          coalesce(code, '') AS ip_classification_code
        FROM versioned_addresses a LEFT JOIN listed_ips l ON l.ip = a.ip AND ip_version = 'v4'""",
    "parse_user_agents": """SELECT log_id, ua_string, ua_class, ua_class_code,
          CASE WHEN ua_version <> '' THEN name || ' ' || ua_version ELSE name END AS ua, ua_version,
          split_part(ua_version, '.', 1) AS ua_version_major, ua_uptodate_current_version, ua_family,
          ua_family_code, ua_family_homepage, ua_family_vendor, ua_family_vendor_code,
          ua_family_vendor_homepage, ua_family_icon, ua_family_icon_big,
          ua_family_info_url, ua_engine, os, os_code, os_homepage, os_icon,
          os_icon_big, os_info_url, os_family, os_family_code, os_family_vendor,
          os_family_vendor_code, os_family_vendor_homepage, device_class,
          device_class_code, device_class_icon, device_class_icon_big,
          device_class_info_url, crawler_last_seen, crawler_category, crawler_category_code,
          crawler_respect_robotstxt, CASE WHEN log_id % 9 = 4 THEN '' ELSE 'v4' END AS ip_ver,
          CASE WHEN log_id % 9 = 4 THEN '' ELSE ip_classification_code END AS ip_classification_code
        FROM described""",
    "is_bot_family": """SELECT ua_family_code AS family_code, is_bot_family, count(*) AS logs
        FROM described GROUP BY ALL""",
    "ua_has_crawler_word": """SELECT ua_string AS user_agent, by_words_only AS has_word, count(*) AS logs
        FROM described GROUP BY ALL""",
    "is_crawler": "SELECT log_id, is_crawler, by_words_only FROM flagged",
    "drop_crawlers": "SELECT log_id, ip, ua_string AS user_agent FROM flagged WHERE NOT is_crawler",
    "human_verdict": f"""SELECT d.log_id, ua_family_code AS family,
          coalesce(prob, 0) > {V.HUMAN_THRESHOLD} AS human
        FROM described d LEFT JOIN sharp_scores s ON s.log_id = d.log_id AND s.class = ua_family_code""",
    "request_verdict": "SELECT request_id, client_ip, user_agent, ua_family_code, verdict FROM verdicts",
    "header_pairs": "SELECT pair, count(*) AS logs FROM pairs GROUP BY pair",
    "order_vocabulary": """SELECT pair, slot, count(log_id) AS logs
        FROM order_slots LEFT JOIN pairs USING (pair) GROUP BY ALL""",
    "order_features": "SELECT log_id, slot FROM order_cells",
    "fit_value_vocabulary": "SELECT feature_name, idx FROM vocabulary",
    "value_features": """SELECT DISTINCT log_id, coalesce(idx, 0) AS slot FROM trimmed_values
          LEFT JOIN (SELECT feature_name, CAST(row_number() OVER (ORDER BY feature_name) - 1 AS INTEGER) AS idx
            FROM (SELECT DISTINCT feature_name FROM trimmed_values JOIN agents USING (log_id)
                  WHERE user_agent NOT LIKE '%Firefox%')) USING (feature_name)""",
    "full_features": "SELECT log_id, CAST(position AS INTEGER) AS position FROM cells",
    "sparse_cells": """SELECT log_id, row, CAST(position AS INTEGER) AS column
        FROM sample_cells JOIN sample USING (log_id)""",
    "fit_label_codes": f"""SELECT text, int_code, CAST(int_code AS DOUBLE) AS float_code
        FROM ({_codes(_FULL_VERSION, "logs")})""",
    "encode_label": f"""SELECT log_id, {_FULL_VERSION} AS ua_version, coalesce(int_code, 0) AS int_code,
          CAST(coalesce(int_code, 0) AS DOUBLE) AS float_code FROM logs
        LEFT JOIN ({_codes(_FULL_VERSION, "logs WHERE ua_family_code = 'firefox'")}) ON text = {_FULL_VERSION}""",
    "one_hot_labels": f"""SELECT log_id, int_code AS label FROM logs
        JOIN ({_codes("ua_string", "logs")}) ON text = ua_string""",
    "prepare_period": f"""SELECT log_id, label, CAST(position AS INTEGER) AS position FROM
          (WITH period AS (SELECT * FROM logs WHERE epoch BETWEEN {PERIOD[0]} AND {PERIOD[1]}),
            codes AS ({_codes("ua_string", "period")}),
            names AS (SELECT feature_name, row_number() OVER (ORDER BY feature_name) - 1 AS idx
              FROM (SELECT DISTINCT feature_name FROM trimmed_values JOIN period USING (log_id)))
          SELECT log_id, int_code AS label, position FROM period JOIN codes ON text = ua_string
            JOIN (SELECT log_id, slot AS position FROM order_cells
              UNION SELECT log_id, 49 + idx FROM trimmed_values JOIN names USING (feature_name)) USING (log_id))""",
    "prepare_sample": """SELECT log_id, ua_family_code AS family, CAST(position AS INTEGER) AS position
        FROM sample JOIN sample_cells USING (log_id)""",
    "sample_summary": "SELECT count(*) AS logs, min(epoch) AS oldest, max(epoch) AS newest FROM sample",
    "logs_in_period": f"""SELECT log_id, epoch, ua_family_code FROM logs
        WHERE epoch BETWEEN {PERIOD[0]} AND {PERIOD[1]}""",
    "newest_logs": f"""SELECT log_id, epoch, ua_family_code FROM logs
        ORDER BY epoch DESC, log_id DESC LIMIT {FIRST_N}""",
    "first_n_in_period": f"""SELECT log_id, epoch, ua_family_code FROM logs
        WHERE epoch BETWEEN {PERIOD[0]} AND {PERIOD[1]} ORDER BY epoch, log_id LIMIT {FIRST_N}""",
    "family_counts": "SELECT ua_family_code, count(*) AS logs FROM logs GROUP BY 1",
    "make_bot_sample": f"""SELECT log_id AS original_id, ua_family_code AS original_ua_family_code,
          false_family AS ua_family_code, ip, {_FULL_VERSION} AS ua_version
        FROM logs JOIN false_families ON original = ua_family_code""",
    "make_bot_sample_seeded": """SELECT log_id AS original_id,
          ua_family_code AS original_ua_family_code, following AS ua_family_code
        FROM logs JOIN (SELECT ua_family_code AS original, coalesce(lead(ua_family_code) OVER cycle,
            first_value(ua_family_code) OVER cycle) AS following
          FROM families WINDOW cycle AS (ORDER BY md5(ua_family_code || ':7'), ua_family_code))
          ON original = ua_family_code""",
    "verdict_counts": "SELECT sample, verdict, count(*) AS requests FROM judged GROUP BY ALL",
    "error_rates": f"""SELECT CAST({V.HUMAN_THRESHOLD} AS DOUBLE) AS threshold,
          count(CASE WHEN sample = 'humans' AND verdict = 'human' THEN 1 END) AS humans_as_human,
          count(CASE WHEN sample = 'humans' AND verdict = 'bot' THEN 1 END) AS humans_as_bot,
          count(CASE WHEN sample = 'bots' AND verdict = 'human' THEN 1 END) AS bots_as_human,
          count(CASE WHEN sample = 'bots' AND verdict = 'bot' THEN 1 END) AS bots_as_bot,
          count(*) AS judged,
          round(CAST(count(CASE WHEN sample = 'humans' AND verdict = 'bot' THEN 1 END) AS DOUBLE)
            * 100 / count(*), 5) AS error_1,
          round(CAST(count(CASE WHEN sample = 'bots' AND verdict = 'human' THEN 1 END) AS DOUBLE)
            * 100 / count(*), 5) AS error_2 FROM judged""",
    "assemble_training_set": """SELECT log_id, ua_family_code AS family,
          coalesce(string_agg(CAST(position AS STRING), ',' ORDER BY position), '') AS columns
        FROM sample LEFT JOIN sample_cells USING (log_id) GROUP BY ALL""",
    "train_family_model": """SELECT ua_family_code AS class, count(*) AS logs,
          (SELECT CAST(max(position) + 1 AS INTEGER) FROM sample_cells) AS width, true AS optimal
        FROM sample GROUP BY ALL""",
    "score_families": "SELECT log_id, class, prob FROM scores",
    "score_by_join": "SELECT log_id, class, prob FROM scores",
    "retrain": f"""SELECT ua_family_code, CASE WHEN log_id IN
            (SELECT log_id FROM entries WHERE k = 'User-Agent' AND v <> '') THEN '{V.VERDICT_HUMAN}'
            ELSE '{V.VERDICT_UNKNOWN}' END AS verdict, count(*) AS logs, CAST(1 AS BIGINT) AS version
        FROM logs GROUP BY ALL""",
    "stream_ingest": "SELECT epoch, ip, ua_string AS user_agent, ua_family_code, os_code FROM logs",
    "stream_verdicts": "SELECT request_id, client_ip, ua_family_code, verdict FROM verdicts",
    "stream_model_refresh": """SELECT request_id,
          CASE WHEN client_ip LIKE '10.1%' THEN verdict ELSE opposite_verdict END AS verdict,
          CAST(CASE WHEN client_ip LIKE '10.1%' THEN 1 ELSE 2 END AS BIGINT) AS model_version FROM verdicts""",
}

ORACLE_SQL: dict[str, str] = {name: _sql(select) for name, select in _SELECTS.items()}
