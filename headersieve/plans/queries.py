"""One query per operator over the given tables.

Every query takes ``(spark, sf_dir)``. Results are flat: maps and arrays are
exploded to rows so that they can be compared value by value.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headersieve.functions import headers as H
from headersieve.functions.addresses import ip_version as ip_version_of
from headersieve.functions.crawlers import is_bot_family, ua_has_crawler_word
from headersieve.functions.fixed_values import TRAINING_SAMPLE
from headersieve.functions.pairs import ORDER_WIDTH, header_pairs, order_vocabulary
from headersieve.functions.scoring import LinearScorer, human_verdict
from headersieve.operators import features as X
from headersieve.operators import labels as Y
from headersieve.operators import match as U
from headersieve.operators import model as M
from headersieve.operators import sampling as A
from headersieve.operators import shred as S
from headersieve.operators import verdict as V
from headersieve.operators.scorer import TableScorer
from headersieve.plans.ingest import ingest_files, ingest_pending
from headersieve.plans.train import retrain, training_tables
from headersieve.session import fresh_path, materialize
from headersieve.sources import fixtures
from headersieve.sources import logs as L
from headersieve.sources import signatures as G
from headersieve.sources import stores as T
from headersieve.sources.agents import AgentDictionary
from headersieve.streaming.ingest import stream_ingest
from headersieve.streaming.verdicts import REQUESTS, stream_verdicts

# The fixture's clock starts here, one event a second.
EPOCH = 1704067200
FIRST_N = 1000
# Scale of the fixed weights at which verdicts differ.
SHARP = 10
# The gradient of the penalised loss that a trained model is allowed.
OPTIMAL = 1e-3


def period(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """From a hundredth to seven tenths of the time that the events cover."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    row = events.agg(F.min("event_id").alias("first"), F.max("event_id").alias("last")).first()
    length = row["last"] - row["first"]
    return tuple(EPOCH + row["first"] + length * share // 100 for share in (1, 70))


@cache
def _signatures(spark: SparkSession) -> G.Signatures:
    return G.load_signatures(fixtures.seed_signatures(spark))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.header_log_lines(spark, sf_dir)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines as they are read from a file."""
    return _lines(spark, sf_dir).select("log_id", "line")


def _shredded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's header maps and user agent."""
    cleaned = S.split_log_line(_raw(spark, sf_dir)).withColumn(
        "header_json", H.clean_header_json(F.col("headers"))
    )
    shredded = S.shred_headers_json(cleaned.drop("headers", "line")).select(
        "log_id",
        F.col("epoch_text").cast("bigint").alias("epoch"),
        F.timestamp_seconds(F.col("epoch_text").cast("bigint")).alias("timestamp"),
        "ip",
        "header_json",
        "value_data",
        "order_data",
    )
    return H.once(shredded, "user_agent", H.pick_user_agent(F.col("value_data")))


def _agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shredded(spark, sf_dir).select("log_id", "ip", "user_agent")


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.parse_user_agents(_agents(spark, sf_dir), _signatures(spark))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted lines as stored logs."""
    return S.project_logs(S.parse_log_lines(_raw(spark, sf_dir), _signatures(spark)))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted lines, written and read back like the ``logs`` table."""
    path = fresh_path(spark, "logs")
    T.write_logs(_logs(spark, sf_dir), path, batch=1)
    return T.read_logs(spark, path)


def _seconds(column: str, name: str) -> Column:
    return F.unix_timestamp(column).alias(name)


def _gz(spark: SparkSession, sf_dir: str) -> str:
    """The lines as gzip files, one directory per hour of the log."""
    path = fresh_path(spark, "gz")
    hourly = _lines(spark, sf_dir).select("line", F.expr("epoch div 3600").alias("hour"))
    hourly.repartition("hour").write.partitionBy("hour").option("compression", "gzip").text(path)
    return path


# --- sources and sinks ---------------------------------------------------------


def read_header_logs(spark, sf_dir):
    return L.read_header_logs(spark, _gz(spark, sf_dir)).select("line")


def latest_log_file(spark, sf_dir):
    path, _ = L.require_latest(spark, _gz(spark, sf_dir))
    lines = L.read_header_logs(spark, path, name_regex=None, recursive=False)
    epoch = F.substring("line", 1, 10).cast("bigint")
    return lines.agg(
        F.count(F.lit(1)).alias("lines"), F.min(epoch).alias("first"), F.max(epoch).alias("last")
    )


def _log_files(spark, sf_dir):
    """File names as a ten-minute log rotation would give them."""
    name = F.concat(F.lit("log-"), F.expr("epoch div 600").cast("string"), F.lit(".gz"))
    return _lines(spark, sf_dir).select(name.alias("file_name"), "ip").distinct()


def pending_files(spark, sf_dir):
    seen = _log_files(spark, sf_dir)
    ledger = seen.filter(F.col("ip").endswith(".0.7")).select("file_name").distinct()
    return L.pending_files(seen.select("file_name").distinct(), ledger)


def ingest_pending_files(spark, sf_dir):
    """Load all files, then once more: nothing is loaded twice."""
    source, store = _gz(spark, sf_dir), fresh_path(spark, "store")
    loaded = [ingest_pending(spark, source, store, _signatures(spark)) for _ in range(2)]
    logs = T.read_logs(spark, f"{store}/logs")
    return logs.groupBy("ua_family_code").agg(
        F.count(F.lit(1)).alias("logs"),
        F.count_distinct("log_id").alias("ids"),
        F.lit(loaded[1]).cast("int").alias("loaded_again"),
    )


def count_lines(spark, sf_dir):
    """A dry run over files of spoiled lines: lines by the reason to reject them."""
    source, store = fresh_path(spark, "messy"), fresh_path(spark, "store")
    fixtures.messy_log_lines(spark, sf_dir).select("line").write.option("compression", "gzip").text(source)
    report = ingest_files(
        spark, source, store, _signatures(spark), start=period(spark, sf_dir)[0], dry_run=True
    )
    return spark.createDataFrame(sorted(report.lines.items()), "reason string, lines bigint").filter("lines > 0")


def write_logs(spark, sf_dir):
    return (
        _stored(spark, sf_dir)
        .groupBy(F.col("log_date").cast("string").alias("log_date"))
        .agg(F.count(F.lit(1)).alias("logs"))
    )


def preview_raw_headers(spark, sf_dir):
    return L.preview_raw_headers(_raw(spark, sf_dir)).select("log_id", "header_json")


def load_signatures(spark, sf_dir):
    """Signature tables written, read back and joined: how many rows each lookup has."""
    path = fresh_path(spark, "signatures")
    for name, df in fixtures.grown_signatures(spark, sf_dir).items():
        df.write.parquet(f"{path}/{name}")
    tables = G.read_signature_tables(spark, path)
    lookups = {
        "clients": G.dim_client_regex(tables),
        "systems": G.dim_os_regex(tables),
        "devices": G.dim_device_regex(tables),
        "crawlers": G.dim_crawlers(tables),
        "addresses": G.dim_ip_class(tables),
    }
    sizes = [
        df.agg(F.count(F.lit(1)).alias("entries")).select(F.lit(name).alias("lookup"), "entries")
        for name, df in lookups.items()
    ]
    first, *rest = sizes
    for size in rest:
        first = first.unionByName(size)
    return first


def save_vocabulary(spark, sf_dir):
    path = fresh_path(spark, "vocabulary")
    T.save_vocabulary(X.fit_value_vocabulary(_shredded(spark, sf_dir)), path)
    return T.load_vocabulary(spark, path)


def save_codes(spark, sf_dir):
    """User agents coded, stored, and decoded again."""
    path, agents = fresh_path(spark, "codes"), _shredded(spark, sf_dir)
    T.save_codes(Y.fit_label_codes(agents, "user_agent"), path)
    coded = Y.encode_label(
        agents.select("log_id", "user_agent"), T.load_codes(spark, path), "user_agent"
    )
    decoded = Y.decode_label(coded, T.load_codes(spark, path), "int_code")
    return decoded.groupBy("text", "int_code").agg(F.count(F.lit(1)).alias("logs"))


def _sample(spark, sf_dir, n=TRAINING_SAMPLE):
    return X.prepare_sample(_stored(spark, sf_dir), n)


def write_training_tables(spark, sf_dir):
    path = fresh_path(spark, "training")
    sample, _ = _sample(spark, sf_dir)
    T.write_training_tables(*training_tables(sample), path)
    cells, browsers = T.read_training_tables(spark, path)
    return cells.join(browsers, "log_id")


def _fixed_scorer(spark, width, scale=1):
    return TableScorer.from_table(fixtures.fixed_coefficients(spark, width, scale))


def _fixed_model(spark, width, scale=1):
    return M.FamilyModel(LinearScorer.from_table(fixtures.fixed_coefficients(spark, width, scale)), None)


def _vocabulary(spark, sf_dir, shredded=None):
    """The vocabulary over all lines, and the width of the features on it."""
    vocabulary = X.fit_value_vocabulary(_shredded(spark, sf_dir) if shredded is None else shredded)
    return vocabulary, ORDER_WIDTH + vocabulary.count()


def save_model(spark, sf_dir):
    """The fixed weights saved as a model version and loaded back."""
    store = fresh_path(spark, "model")
    vocabulary, width = _vocabulary(spark, sf_dir)
    T.save_model(spark, _fixed_model(spark, width), vocabulary, store)
    model = T.load_model(spark, store)
    return model.coefficients.withColumn("width", F.lit(model.width).cast("int"))


def write_test_logs(spark, sf_dir):
    path = fresh_path(spark, "test-logs")
    T.write_test_logs(A.make_bot_sample(_stored(spark, sf_dir)), path)
    return spark.read.parquet(path).select(
        "original_id", "original_ua_family_code", "ua_family_code", _seconds("timestamp", "epoch")
    )


# --- shredding, projection, filters --------------------------------------------


def split_log_line(spark, sf_dir):
    return S.split_log_line(_raw(spark, sf_dir)).select("log_id", "epoch_text", "ip", "headers")


def reject_reason(spark, sf_dir):
    lines = fixtures.messy_log_lines(spark, sf_dir)
    rejected = S.reject_reason(lines, _signatures(spark), start=period(spark, sf_dir)[0])
    return rejected.select("log_id", "reason")


def filter_time_range(spark, sf_dir):
    lines = S.split_log_line(_raw(spark, sf_dir))
    timed = lines.select("log_id", S.epoch_of(F.col("epoch_text")).alias("epoch"))
    return S.filter_time_range(timed, *period(spark, sf_dir))


def clean_header_json(spark, sf_dir):
    lines = S.split_log_line(_raw(spark, sf_dir))
    return lines.select("log_id", H.clean_header_json(F.col("headers")).alias("header_json"))


def shred_headers_json(spark, sf_dir):
    return S.header_entries(_shredded(spark, sf_dir)).select("log_id", F.inline("entries"))


def raw_headers_with_crawlers(spark, sf_dir):
    raw = S.raw_headers_with_crawlers(_raw(spark, sf_dir), *period(spark, sf_dir))
    return raw.select("log_id", "epoch", "ip", "header_json")


def _requests(spark, sf_dir):
    return fixtures.request_bodies(S.header_entries(_shredded(spark, sf_dir)))


def shred_request_body(spark, sf_dir):
    shredded = S.shred_request_body(_requests(spark, sf_dir))
    return shredded.select("request_id", "client_ip", "user_agent", F.inline("entries"))


def pick_user_agent(spark, sf_dir):
    n = F.col("log_id")
    second = F.when(n % 7 == 3, F.lit("second/2")).when(n % 7 == 5, F.lit(""))
    # Some lines get a second spelling, with another agent or an empty one.
    others = F.map_filter("value_data", lambda k, v: second.isNull() | (k != "user-agent"))
    added = F.when(second.isNotNull(), F.create_map(F.lit("user-agent"), second))
    values = F.map_concat(others, F.coalesce(added, F.create_map().cast("map<string,string>")))
    return _shredded(spark, sf_dir).select(
        "log_id",
        H.pick_user_agent(values, "online").alias("online"),
        H.pick_user_agent(values, "legacy").alias("legacy"),
        H.pick_user_agent(values, "evaluation").alias("evaluation"),
    )


def trim_order(spark, sf_dir):
    trimmed = H.trim_order(F.col("order_data"))
    return _shredded(spark, sf_dir).select("log_id", F.explode(trimmed).alias("header", "pos"))


def trim_values(spark, sf_dir):
    trimmed = H.trim_values(F.col("value_data"))
    return _shredded(spark, sf_dir).select("log_id", F.explode(trimmed).alias("header", "value"))


def parse_log_lines(spark, sf_dir):
    parsed = S.parse_log_lines(_raw(spark, sf_dir), _signatures(spark))
    return parsed.withColumns(
        {"headers": F.size("value_data"), "positions": F.size("order_data")}
    ).drop("value_data", "order_data")


def project_logs(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    return logs.withColumns(
        {
            "timestamp": F.unix_timestamp("timestamp"),
            "host": F.coalesce(F.col("value_data")["Host"], F.col("value_data")["host"]),
            "host_position": F.coalesce(F.col("order_data")["Host"], F.col("order_data")["host"]),
        }
    ).drop("value_data", "order_data")


# --- dimension joins -----------------------------------------------------------


def dim_client_regex(spark, sf_dir):
    return G.dim_client_regex(fixtures.grown_signatures(spark, sf_dir)).select(
        "class_id", "client_id", "sequence", "pattern", "name", "name_code", "homepage",
        "icon", "engine", "vendor", "vendor_code", "uptodate_current_version",
        "client_classification", "client_classification_code",
    )


def dim_os_regex(spark, sf_dir):
    return G.dim_os_regex(fixtures.grown_signatures(spark, sf_dir)).select(
        "os_id", "sequence", "pattern", "family", "family_code", "name", "name_code", "vendor"
    )


def dim_device_regex(spark, sf_dir):
    return G.dim_device_regex(fixtures.grown_signatures(spark, sf_dir)).select(
        "deviceclass_id", "sequence", "pattern", "name", "name_code", "icon"
    )


def dim_ip_class(spark, sf_dir):
    return G.dim_ip_class(fixtures.grown_signatures(spark, sf_dir))


def dim_crawlers(spark, sf_dir):
    return G.dim_crawlers(fixtures.grown_signatures(spark, sf_dir)).select(
        "ua_string", "botid", "name", "ver", "family", "family_code", "vendor",
        "crawler_classification", "crawler_classification_code",
    )


# --- lookups and pattern joins -------------------------------------------------


def match_crawler_ua(spark, sf_dir):
    matched = U.match_crawler_ua(_agents(spark, sf_dir), _signatures(spark))
    fields = ("name", "ver", "family_code", "last_seen", "crawler_classification_code")
    return matched.select("log_id", *(F.col(f"crawler.{f}").alias(f) for f in fields))


def match_client_regex(spark, sf_dir):
    matched = U.match_crawler_ua(_agents(spark, sf_dir), _signatures(spark))
    matched = U.match_client_regex(matched, _signatures(spark))
    return matched.select(
        "log_id",
        F.col("client_hit.id").cast("int").alias("client_id"),
        F.col("client_hit.version").alias("version"),
        F.col("client.name_code").alias("family_code"),
        F.col("client.client_classification_code").alias("class_code"),
    )


def match_os_regex(spark, sf_dir):
    matched = U.match_os_regex(_agents(spark, sf_dir), _signatures(spark))
    return matched.select(
        "log_id", F.col("os.name_code").alias("os_code"), F.col("os.family").alias("os_family")
    )


def match_device_regex(spark, sf_dir):
    matched = U.match_device_regex(_agents(spark, sf_dir), _signatures(spark))
    return matched.select("log_id", F.col("device.name_code").alias("device_class_code"))


@cache
def _pattern_signatures(spark: SparkSession, sf_dir: str) -> G.Signatures:
    return G.load_signatures(fixtures.pattern_signatures(spark, sf_dir))


def _matched(spark, sf_dir, kind):
    """Distinct agents and their first match among a pattern for every part."""
    agents = fixtures.grown_agents(spark, sf_dir)
    hit = F.col("hit")
    matched = U.match_rules(agents, getattr(_pattern_signatures(spark, sf_dir), kind), F.col("user_agent"), "hit")
    return matched.select("user_agent", hit["id"].alias("id"), hit["version"].alias("version"))


def match_client_index(spark, sf_dir):
    return _matched(spark, sf_dir, "clients")


def match_os_index(spark, sf_dir):
    return _matched(spark, sf_dir, "systems")


def agent_dictionary(spark, sf_dir):
    """The first agents become known, then all: only the rest is identified the second time."""
    agents = fixtures.grown_agents(spark, sf_dir)
    dictionary = AgentDictionary(spark, fresh_path(spark, "agents"), _pattern_signatures(spark, sf_dir))
    first, rest, again = (dictionary.add(part) for part in (agents.filter("first_line <= 3"), agents, agents))
    return dictionary.known().withColumns({"first": F.lit(first), "rest": F.lit(rest), "again": F.lit(again)})


def _address_variants(spark, sf_dir):
    """Addresses of many spellings, made from each line's own."""
    lines = _lines(spark, sf_dir).select("log_id", "ip")
    n = F.col("log_id")
    hexed = F.lower(F.hex(n))
    text = (
        F.when(n % 11 == 0, F.concat(F.lit("::ffff:"), "ip"))
        .when(n % 11 == 1, F.concat(F.lit("2001:db8::"), hexed))
        .when(n % 11 == 2, F.concat("ip", F.lit(".1")))
        .when(n % 11 == 3, F.concat(F.lit("999."), "ip"))
        .when(n % 11 == 4, F.concat(F.lit("fe80:0:0:0:1:2:3:"), hexed))
        .when(n % 11 == 5, F.lit(""))
        .when(n % 11 == 6, F.concat(F.lit("2001::db8::"), hexed))
        .otherwise(F.col("ip"))
    )
    return lines.select("log_id", text.alias("ip"))


def ip_version(spark, sf_dir):
    variants = _address_variants(spark, sf_dir)
    return variants.select("log_id", "ip", ip_version_of(F.col("ip")).alias("ip_version"))


def classify_ip(spark, sf_dir):
    classified = U.classify_ip(_address_variants(spark, sf_dir), _signatures(spark))
    return classified.select(
        "log_id",
        F.col("address.ip").alias("ip"),
        F.col("address.ip_ver").alias("ip_ver"),
        F.col("address.ip_classification_code").alias("ip_classification_code"),
    )


def parse_user_agents(spark, sf_dir):
    """Every ninth address is turned into one of version 6, which no list knows."""
    agents = _agents(spark, sf_dir)
    ip = F.when(F.col("log_id") % 9 == 4, F.concat(F.lit("2001:db8::"), F.lit("a"))).otherwise(F.col("ip"))
    described = U.parse_user_agents(agents.withColumn("ip", ip), _signatures(spark))
    return described.select("log_id", "ua.*", "address.ip_ver", "address.ip_classification_code")


# --- crawler predicates and verdicts -------------------------------------------


def is_bot_family_counts(spark, sf_dir):
    family = F.col("ua.ua_family_code")
    return (
        _described(spark, sf_dir)
        .groupBy(family.alias("family_code"), is_bot_family(family).alias("is_bot_family"))
        .agg(F.count(F.lit(1)).alias("logs"))
    )


def ua_has_crawler_word_counts(spark, sf_dir):
    agent = F.col("user_agent")
    return (
        _agents(spark, sf_dir)
        .groupBy("user_agent", ua_has_crawler_word(agent).alias("has_word"))
        .agg(F.count(F.lit(1)).alias("logs"))
    )


def is_crawler(spark, sf_dir):
    return _described(spark, sf_dir).select(
        "log_id",
        V.crawler_flag().alias("is_crawler"),
        V.crawler_flag(words_only=True).alias("by_words_only"),
    )


def drop_crawlers(spark, sf_dir):
    return V.drop_crawlers(_described(spark, sf_dir)).select("log_id", "ip", "user_agent")


def human_verdicts(spark, sf_dir):
    vocabulary, width = _vocabulary(spark, sf_dir)
    described = U.parse_user_agents(_shredded(spark, sf_dir), _signatures(spark))
    full = X.full_features(described, vocabulary)
    scored = V.score_families(full, _fixed_scorer(spark, width, SHARP))
    human = human_verdict(F.col("probs"), F.col("ua.ua_family_code"))
    return scored.select("log_id", F.col("ua.ua_family_code").alias("family"), human.alias("human"))


def request_verdict(spark, sf_dir):
    vocabulary, width = _vocabulary(spark, sf_dir)
    return V.judge_requests(
        _requests(spark, sf_dir), _signatures(spark), vocabulary, _fixed_scorer(spark, width, SHARP)
    )


# --- features and labels -------------------------------------------------------


def header_pair_counts(spark, sf_dir):
    pairs = H.once(_shredded(spark, sf_dir), "pairs", header_pairs(F.col("order_data")))
    return pairs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("logs"))


def order_vocabulary_use(spark, sf_dir):
    """Each slot's pair and in how many logs it occurs."""
    used = header_pair_counts(spark, sf_dir)
    return (
        order_vocabulary(spark)
        .join(used, "pair", "left")
        .select("pair", "slot", F.coalesce("logs", F.lit(0)).alias("logs"))
    )


def order_features(spark, sf_dir):
    slots = X.order_features(_shredded(spark, sf_dir))
    return slots.select("log_id", F.explode("order_slots").alias("slot"))


def fit_value_vocabulary(spark, sf_dir):
    return X.fit_value_vocabulary(_shredded(spark, sf_dir))


def value_features(spark, sf_dir):
    """Slots on the vocabulary of all lines but those of Firefox, so that values of its own are unseen."""
    shredded = _shredded(spark, sf_dir)
    others = shredded.filter(~F.col("user_agent").contains("Firefox"))
    slots = X.value_features(shredded, X.fit_value_vocabulary(others))
    return slots.select("log_id", F.explode("value_slots").alias("slot"))


def full_features(spark, sf_dir):
    vocabulary, _ = _vocabulary(spark, sf_dir)
    full = X.full_features(_shredded(spark, sf_dir), vocabulary)
    return full.select("log_id", F.explode("positions").alias("position"))


def sparse_cells(spark, sf_dir):
    sample, _ = _sample(spark, sf_dir)
    cells, _ = training_tables(sample)
    return cells


def fit_label_codes(spark, sf_dir):
    return Y.fit_label_codes(_stored(spark, sf_dir), "ua_version")


def encode_label(spark, sf_dir):
    """Codes fitted on one family's versions: the others are unknown."""
    logs = _stored(spark, sf_dir)
    known = Y.fit_label_codes(logs.filter(F.col("ua_family_code") == "firefox"), "ua_version")
    return Y.encode_label(logs.select("log_id", "ua_version"), known, "ua_version")


def one_hot_labels(spark, sf_dir):
    logs = _stored(spark, sf_dir)
    codes = Y.fit_label_codes(logs, "user_agent")
    return Y.one_hot_labels(logs.select("log_id", "user_agent"), codes, "user_agent").select(
        "log_id", "label"
    )


def prepare_period(spark, sf_dir):
    features, _, _ = X.prepare_period(_stored(spark, sf_dir), *period(spark, sf_dir))
    return features.select("log_id", "label", F.explode("positions").alias("position"))


def prepare_sample(spark, sf_dir):
    sample, _ = _sample(spark, sf_dir)
    return sample.select("log_id", "family", F.explode("positions").alias("position"))


# --- sampling and evaluation ---------------------------------------------------


def sample_summary(spark, sf_dir):
    newest = A.newest_logs(_stored(spark, sf_dir), TRAINING_SAMPLE)
    return A.sample_summary(newest).select(
        "logs", _seconds("oldest", "oldest"), _seconds("newest", "newest")
    )


def logs_in_period(spark, sf_dir):
    logs = A.logs_in_period(_stored(spark, sf_dir), *period(spark, sf_dir))
    return logs.select("log_id", _seconds("timestamp", "epoch"), "ua_family_code")


def newest_logs(spark, sf_dir):
    logs = A.newest_logs(_stored(spark, sf_dir), FIRST_N)
    return logs.select("log_id", _seconds("timestamp", "epoch"), "ua_family_code")


def first_n_in_period(spark, sf_dir):
    logs = A.first_n_in_period(_stored(spark, sf_dir), *period(spark, sf_dir), FIRST_N)
    return logs.select("log_id", _seconds("timestamp", "epoch"), "ua_family_code")


def family_counts(spark, sf_dir):
    return A.family_counts(_logs(spark, sf_dir))


def make_bot_sample(spark, sf_dir):
    return A.make_bot_sample(_logs(spark, sf_dir)).select(
        "original_id", "original_ua_family_code", "ua_family_code", "ip", "ua_version"
    )


def make_bot_sample_seeded(spark, sf_dir):
    return A.make_bot_sample(_logs(spark, sf_dir), seed=7).select(
        "original_id", "original_ua_family_code", "ua_family_code"
    )


def _judged(spark, sf_dir):
    """The stored logs, and the same under a false family, both judged."""
    logs = _stored(spark, sf_dir)
    vocabulary, width = _vocabulary(spark, sf_dir)
    scorer = _fixed_scorer(spark, width, SHARP)
    return (
        V.judge_logs(A.make_bot_sample(logs), vocabulary, scorer),
        V.judge_logs(logs, vocabulary, scorer),
    )


def verdict_counts(spark, sf_dir):
    bots, humans = _judged(spark, sf_dir)
    return (
        V.verdict_counts(bots).withColumn("sample", F.lit("bots"))
        .unionByName(V.verdict_counts(humans).withColumn("sample", F.lit("humans")))
    )


def error_rates(spark, sf_dir):
    return V.error_rates(*_judged(spark, sf_dir))


# --- model ---------------------------------------------------------------------


def _training_set(spark, sf_dir):
    cells, browsers = training_tables(_sample(spark, sf_dir)[0])
    return materialize(M.assemble_training_set(cells, browsers), "training")


def assemble_training_set(spark, sf_dir):
    assembled = _training_set(spark, sf_dir)
    columns = F.array_join(F.col("positions").cast("array<string>"), ",")
    return assembled.select("log_id", "family", columns.alias("columns"))


def train_family_model(spark, sf_dir):
    """Each class of a trained model: its logs, the columns it has weights for, and whether they are the best."""
    training = _training_set(spark, sf_dir)
    model = M.train_family_model(training)
    logs = training.groupBy(F.col("family").alias("class")).agg(F.count(F.lit(1)).alias("logs"))
    residual = M.optimality_residual(training, model)
    return residual.join(logs, "class").select(
        "class",
        "logs",
        F.lit(model.scorer.width).cast("int").alias("width"),
        (F.col("residual") < OPTIMAL).alias("optimal"),
    )


def score_families(spark, sf_dir):
    vocabulary, width = _vocabulary(spark, sf_dir)
    full = X.full_features(_shredded(spark, sf_dir), vocabulary)
    scored = V.score_families(full, _fixed_scorer(spark, width))
    return scored.select("log_id", F.explode("probs").alias("class", "prob"))


def score_by_join(spark, sf_dir):
    """The same scores from a table of weights instead of an expression."""
    vocabulary, width = _vocabulary(spark, sf_dir)
    full = X.full_features(_shredded(spark, sf_dir), vocabulary)
    return V.score_by_join(full, fixtures.fixed_coefficients(spark, width))


def retrain_and_judge(spark, sf_dir):
    """Retrain on the stored logs, load what was published and judge the logs with it."""
    store, logs = fresh_path(spark, "model"), _stored(spark, sf_dir)
    retrain(spark, logs, store)
    model = T.load_model(spark, store)
    judged = V.judge_logs(logs, model.vocabulary, model.scorer)
    return (
        judged.groupBy("ua_family_code", "verdict")
        .agg(F.count(F.lit(1)).alias("logs"))
        .withColumn("version", F.lit(model.version).cast("bigint"))
    )


# --- streaming -----------------------------------------------------------------


def stream_ingest_files(spark, sf_dir):
    source, out = _gz(spark, sf_dir), fresh_path(spark, "streamed")
    for _ in range(2):
        stream_ingest(spark, source, out, f"{out}-checkpoint", _signatures(spark)).awaitTermination()
    return T.read_logs(spark, out).select(
        _seconds("timestamp", "epoch"), "ip", "user_agent", "ua_family_code", "os_code"
    )


def _published_fixed(spark, sf_dir, store, scale, shredded=None):
    vocabulary, width = _vocabulary(spark, sf_dir, shredded)
    T.save_model(spark, _fixed_model(spark, width, scale), vocabulary, store)


def _stream_of(spark, path):
    return spark.readStream.schema(REQUESTS).parquet(path)


def stream_verdicts_of_requests(spark, sf_dir):
    store, source, out = (fresh_path(spark, n) for n in ("model", "requests", "verdicts"))
    _published_fixed(spark, sf_dir, store, SHARP)
    _requests(spark, sf_dir).write.parquet(source)
    stream_verdicts(
        _stream_of(spark, source), _signatures(spark), store, out, f"{out}-checkpoint"
    ).awaitTermination()
    return spark.read.parquet(out).select("request_id", "client_ip", "ua_family_code", "verdict")


def stream_model_refresh(spark, sf_dir):
    """One network's requests come first; then a new model is published, then the others'."""
    store, source, out = (fresh_path(spark, n) for n in ("model", "requests", "verdicts"))
    # The lines are taken apart once; the requests and both vocabularies are made from what was written.
    shredded = materialize(_shredded(spark, sf_dir), "shredded")
    requests = materialize(fixtures.request_bodies(S.header_entries(shredded)), "requests")
    first = F.col("client_ip").startswith("10.1")
    for arriving, scale in ((first, SHARP), (~first, -SHARP)):
        _published_fixed(spark, sf_dir, store, scale, shredded)
        requests.filter(arriving).write.mode("append").parquet(source)
        stream_verdicts(
            _stream_of(spark, source), _signatures(spark), store, out, f"{out}-checkpoint"
        ).awaitTermination()
    return spark.read.parquet(out).select("request_id", "verdict", "model_version")


QUERIES = {
    "read_header_logs": read_header_logs,
    "latest_log_file": latest_log_file,
    "pending_files": pending_files,
    "ingest_pending": ingest_pending_files,
    "count_lines": count_lines,
    "write_logs": write_logs,
    "preview_raw_headers": preview_raw_headers,
    "load_signatures": load_signatures,
    "save_vocabulary": save_vocabulary,
    "save_codes": save_codes,
    "write_training_tables": write_training_tables,
    "save_model": save_model,
    "write_test_logs": write_test_logs,
    "split_log_line": split_log_line,
    "reject_reason": reject_reason,
    "filter_time_range": filter_time_range,
    "clean_header_json": clean_header_json,
    "shred_headers_json": shred_headers_json,
    "raw_headers_with_crawlers": raw_headers_with_crawlers,
    "shred_request_body": shred_request_body,
    "pick_user_agent": pick_user_agent,
    "trim_order": trim_order,
    "trim_values": trim_values,
    "parse_log_lines": parse_log_lines,
    "project_logs": project_logs,
    "dim_client_regex": dim_client_regex,
    "dim_os_regex": dim_os_regex,
    "dim_device_regex": dim_device_regex,
    "dim_ip_class": dim_ip_class,
    "dim_crawlers": dim_crawlers,
    "match_crawler_ua": match_crawler_ua,
    "match_client_regex": match_client_regex,
    "match_os_regex": match_os_regex,
    "match_device_regex": match_device_regex,
    "match_client_index": match_client_index,
    "match_os_index": match_os_index,
    "agent_dictionary": agent_dictionary,
    "ip_version": ip_version,
    "classify_ip": classify_ip,
    "parse_user_agents": parse_user_agents,
    "is_bot_family": is_bot_family_counts,
    "ua_has_crawler_word": ua_has_crawler_word_counts,
    "is_crawler": is_crawler,
    "drop_crawlers": drop_crawlers,
    "human_verdict": human_verdicts,
    "request_verdict": request_verdict,
    "header_pairs": header_pair_counts,
    "order_vocabulary": order_vocabulary_use,
    "order_features": order_features,
    "fit_value_vocabulary": fit_value_vocabulary,
    "value_features": value_features,
    "full_features": full_features,
    "sparse_cells": sparse_cells,
    "fit_label_codes": fit_label_codes,
    "encode_label": encode_label,
    "one_hot_labels": one_hot_labels,
    "prepare_period": prepare_period,
    "prepare_sample": prepare_sample,
    "sample_summary": sample_summary,
    "logs_in_period": logs_in_period,
    "newest_logs": newest_logs,
    "first_n_in_period": first_n_in_period,
    "family_counts": family_counts,
    "make_bot_sample": make_bot_sample,
    "make_bot_sample_seeded": make_bot_sample_seeded,
    "verdict_counts": verdict_counts,
    "error_rates": error_rates,
    "assemble_training_set": assemble_training_set,
    "train_family_model": train_family_model,
    "score_families": score_families,
    "score_by_join": score_by_join,
    "retrain": retrain_and_judge,
    "stream_ingest": stream_ingest_files,
    "stream_verdicts": stream_verdicts_of_requests,
    "stream_model_refresh": stream_model_refresh,
}
