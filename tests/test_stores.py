"""Files, ledger, model versions and streams."""

import gzip
import os
import time
from dataclasses import replace

import pytest
from pyspark.sql import Row

from headersieve.operators import sampling as A
from headersieve.operators.model import FamilyModel
from headersieve.operators.scorer import TableScorer
from headersieve.plans import ingest as I
from headersieve.plans import queries as Q
from headersieve.plans.ingest import ingest_pending
from headersieve.plans.train import retrain
from headersieve.functions.scoring import LinearScorer
from headersieve.sources import logs as L
from headersieve.sources import stores as T
from headersieve.sources.claims import Claims
from headersieve.streaming import ingest as SI
from headersieve.streaming.ingest import stream_ingest
from headersieve.streaming.verdicts import verdict_stream

CHROME = "Mozilla\\/5.0 (Windows NT 10.0) Chrome\\/60.0.1 Safari\\/537.36"


def log_line(n, agent=CHROME):
    return f"{1503090000 + n},1.2.3.{n % 200},'{{\"Host\":\"h\",\"User-Agent\":\"{agent}\"}}'"


def write_gz(path, texts):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with gzip.open(path, "wt") as out:
        out.write("\n".join(texts) + "\n")


@pytest.fixture
def source(tmp_path):
    root = tmp_path / "logs"
    write_gz(str(root / "a" / "2017-02-01.log.gz"), [log_line(n) for n in range(5)])
    write_gz(str(root / "b" / "2017-02-02.log.gz"), [log_line(n) for n in range(5, 8)])
    (root / "b" / "notes.txt").write_text("1503090000,not a log")
    return str(root)


def test_files_are_chosen_by_name(spark, source):
    names = [r["file_name"] for r in L.list_log_files(spark, source).collect()]
    assert sorted(names) == ["2017-02-01.log.gz", "2017-02-02.log.gz"]
    assert L.read_header_logs(spark, source).count() == 8
    assert L.read_header_logs(spark, source, "02-02.*gz").count() == 3
    assert L.read_header_logs(spark, source, r"log\.gz").count() == 8
    assert L.read_header_logs(spark, source, "2.log.gz").count() == 3
    assert L.read_header_logs(spark, source, "2017.02").count() == 8
    assert L.require_latest(spark, source)[1] == "2017-02-02.log.gz"


def test_plain_file_and_missing_files(spark, tmp_path):
    path = tmp_path / "plain.log"
    path.write_text(log_line(1) + "\n" + log_line(2) + "\n")
    assert L.read_header_logs(spark, str(path), name_regex=None).count() == 2
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        L.require_latest(spark, str(tmp_path / "empty"))


def test_ids_are_unique(spark, source):
    lines = L.read_header_logs(spark, source)
    assert lines.select("log_id").distinct().count() == 8


def test_ingest_loads_each_file_once(spark, source, signatures, tmp_path):
    store = str(tmp_path / "store")
    assert ingest_pending(spark, source, store, signatures) == 2
    assert ingest_pending(spark, source, store, signatures) == 0
    write_gz(f"{source}/b/2017-02-03.log.gz", [log_line(n) for n in range(8, 12)])
    assert ingest_pending(spark, source, store, signatures) == 1
    logs = T.read_logs(spark, f"{store}/logs")
    assert logs.count() == 12 == logs.select("log_id").distinct().count()
    assert L.read_ledger(spark, f"{store}/ledger").count() == 3


def test_broken_off_batch_is_replaced(spark, source, signatures, tmp_path):
    """A batch written without its ledger entry is written again, not twice."""
    store = str(tmp_path / "store")
    lines = L.read_header_logs(spark, source)
    half = Q.S.project_logs(Q.S.parse_log_lines(lines.limit(3), signatures))
    T.write_logs(half, f"{store}/logs", batch=1)
    assert ingest_pending(spark, source, store, signatures) == 2
    assert T.read_logs(spark, f"{store}/logs").count() == 8


def test_ingest_modes(spark, source, signatures, tmp_path):
    store = str(tmp_path / "store")
    assert ingest_pending(spark, source, store, signatures, mode="latest", dry_run=True) == 1
    assert L.read_ledger(spark, f"{store}/ledger").isEmpty()
    assert ingest_pending(spark, source, store, signatures, mode="latest") == 1
    with pytest.raises(FileExistsError):
        ingest_pending(spark, source, store, signatures, mode="latest")
    one = f"{source}/a/2017-02-01.log.gz"
    assert ingest_pending(spark, one, store, signatures, mode="one") == 1
    with pytest.raises(FileExistsError):
        ingest_pending(spark, one, store, signatures, mode="one")
    assert T.read_logs(spark, f"{store}/logs").count() == 8


def test_equal_names_in_other_folders_are_other_files(spark, source, signatures, tmp_path):
    store = str(tmp_path / "store")
    assert ingest_pending(spark, source, store, signatures) == 2
    write_gz(f"{source}/c/2017-02-01.log.gz", [log_line(n) for n in range(20, 23)])
    assert ingest_pending(spark, source, store, signatures) == 1
    assert ingest_pending(spark, source, store, signatures) == 0
    assert T.read_logs(spark, f"{store}/logs").count() == 11


def test_backlog_is_cut_by_bytes(spark, source, signatures, tmp_path):
    rows = [Row(file_path=str(k), file_name=str(k), file_size=n) for k, n in enumerate([5, 5, 30, 1, 9, 2])]
    assert [[r.file_size for r in g] for g in I.cut_by_bytes(rows, 10)] == [[5, 5], [30], [1, 9], [2]]
    assert I.cut_by_bytes([], 10) == []
    store = str(tmp_path / "store")
    report = I.ingest_files(spark, source, store, signatures, batch_bytes=1)
    assert (report.files, len(report.batches)) == (2, 2)
    assert L.read_ledger(spark, f"{store}/ledger").select("batch").distinct().count() == 2
    logs = T.read_logs(spark, f"{store}/logs")
    assert logs.count() == 8 == logs.select("log_id").distinct().count()


@pytest.mark.parametrize("dry_run", [True, False])
def test_lines_are_counted_by_the_job_that_loads_them(spark, signatures, tmp_path, dry_run):
    source, store = str(tmp_path / "logs"), str(tmp_path / "store")
    bad = ["junk", "x503090000" + log_line(1)[10:], log_line(2, ""), log_line(3, "Java\\/1.8"), log_line(4, "Nobody"), log_line(5)[:30]]
    write_gz(f"{source}/x.gz", [*bad, *(log_line(n) for n in range(6, 9))])
    report = I.ingest_files(spark, source, store, signatures, dry_run=dry_run)
    lines = L.read_header_logs(spark, source)
    want = {r[0] or "accepted": r[1] for r in Q.S.reject_reason(lines, signatures).groupBy("reason").count().collect()}
    assert {k: n for k, n in report.lines.items() if n} == want | {"read": 9}
    assert set(want) - {"accepted"} <= set(Q.S.REASONS) and len(want) >= 4
    assert T.read_or_empty(spark, f"{store}/logs", T.LOGS).count() == (0 if dry_run else want["accepted"])


def test_two_ingests_at_once_load_each_line_once(spark, source, signatures, tmp_path, monkeypatch):
    """The second run starts while the first one writes; a new file has come in between."""
    store, real, others = str(tmp_path / "store"), I.write_logs, []

    def meanwhile(*args, **options):
        if not others:
            others.append(None)
            write_gz(f"{source}/c/2017-02-03.log.gz", [log_line(n) for n in range(8, 12)])
            others[0] = I.ingest_files(spark, source, store, signatures)
            with pytest.raises(FileExistsError):
                ingest_pending(spark, f"{source}/a/2017-02-01.log.gz", store, signatures, mode="one")
        real(*args, **options)

    monkeypatch.setattr(I, "write_logs", meanwhile)
    first = I.ingest_files(spark, source, store, signatures)
    assert (first.files, others[0].files) == (2, 1) and set(first.batches).isdisjoint(others[0].batches)
    logs = T.read_logs(spark, f"{store}/logs")
    assert logs.count() == 12 == logs.select("log_id").distinct().count()
    assert ingest_pending(spark, source, store, signatures) == 0
    assert Claims(spark, f"{store}/claims").held("file").isEmpty()


def test_files_of_a_killed_run_are_loaded_when_its_claim_has_run_out(spark, source, signatures, tmp_path, monkeypatch):
    store = str(tmp_path / "store")

    def killed(*args, **options):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(I, "note_batch", killed)
        patch.setattr(I.Claims, "release", lambda *args: None)  # killed before it could give anything back
        with pytest.raises(KeyboardInterrupt):
            ingest_pending(spark, source, store, signatures, lease=6)
    assert T.read_logs(spark, f"{store}/logs").count() == 8
    while not Claims(spark, f"{store}/claims").held("file").filter("not abandoned").isEmpty():
        time.sleep(1)
    assert ingest_pending(spark, source, store, signatures) == 2
    logs = T.read_logs(spark, f"{store}/logs")
    assert logs.count() == 8 == logs.select("log_id").distinct().count()


def test_a_failed_run_gives_its_files_back(spark, source, signatures, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    with monkeypatch.context() as patch:
        patch.setattr(I, "write_logs", lambda *args, **options: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest_pending(spark, source, store, signatures)
    assert ingest_pending(spark, source, store, signatures) == 2


def test_numbers_drawn_at_once_are_lost_to_both(spark, tmp_path):
    path = str(tmp_path / "claims")
    one, two = Claims(spark, path, pause=lambda _: None), Claims(spark, path)
    real = one._add

    def raced(kind, entries, live=True):
        if not raced.done:
            raced.done = True
            two._add(kind, entries)  # the same number, between the look and the claim
        real(kind, entries, live)

    raced.done = False
    one._add = raced
    assert one.draw("batch", 1, 100, 50) == (2, 150)
    assert two.draw("batch", 1, 100, 50) == (3, 200)
    assert two.draw("version", 7) == (7, 0)


def test_two_trainers_at_once_get_different_versions(spark, tmp_path, monkeypatch):
    store, real, versions = str(tmp_path / "models"), T.overwrite, []
    vocabulary = spark.createDataFrame([("Accept=a", 0)], "feature_name string, idx int")

    def meanwhile(df, path):
        if not versions:
            versions.append(None)
            versions[0] = T.save_model(spark, fixed_model(50, 2.0), vocabulary, store)
        real(df, path)

    monkeypatch.setattr(T, "overwrite", meanwhile)
    versions.append(T.save_model(spark, fixed_model(50, 1.0), vocabulary, store))
    assert sorted(versions) == [1, 2]
    for version, up in zip(versions, (2.0, 1.0)):
        assert T.load_model(spark, store, version).scorer.head.intercepts == [up, -up]


def test_streams_and_batches_share_a_store(spark, source, signatures, tmp_path):
    """Each owner counts its batches for itself, so none replaces another's."""
    logs = str(tmp_path / "store" / "logs")
    for k in range(2):
        folder, checkpoint = f"{source}-{k}", str(tmp_path / f"checkpoint-{k}")
        write_gz(f"{folder}/x.gz", [log_line(30 + 2 * k), log_line(31 + 2 * k)])
        stream_ingest(spark, folder, logs, checkpoint, signatures).awaitTermination()
    ingest_pending(spark, source, str(tmp_path / "store"), signatures)
    stored = T.read_logs(spark, logs)
    assert stored.count() == 12
    assert stored.where("created_at IS NULL").isEmpty()


def test_periods_open_only_their_days(spark, sf_dir):
    logs = Q._stored(spark, sf_dir)
    period = A.logs_in_period(logs, *Q.period(spark, sf_dir), ordered=True)
    plan = period._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "log_date" in plan.split("PartitionFilters")[1][:120]
    times = [r["timestamp"] for r in period.select("timestamp").collect()]
    assert times == sorted(times) and len(times) > 0


def test_retraining_on_nothing(spark, sf_dir, tmp_path):
    store = str(tmp_path / "models")
    assert retrain(spark, Q._stored(spark, sf_dir).limit(0), store) == 1
    model = T.load_model(spark, store)
    assert model.version == 1 and model.coefficients.isEmpty()


def test_batch_of_rejected_lines_only(spark, signatures, tmp_path):
    source, store = str(tmp_path / "logs"), str(tmp_path / "store")
    write_gz(f"{source}/x.gz", ["junk", log_line(1, "Java\\/1.8")])
    assert ingest_pending(spark, source, store, signatures) == 1
    assert ingest_pending(spark, source, store, signatures) == 0
    assert T.read_logs(spark, f"{store}/logs").isEmpty()


def test_stream_ingest_equals_batch(spark, source, signatures, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for _ in range(2):
        stream_ingest(spark, source, out, checkpoint, signatures).awaitTermination()
    write_gz(f"{source}/c/2017-02-04.log.gz", [log_line(n) for n in range(8, 10)])
    stream_ingest(spark, source, out, checkpoint, signatures).awaitTermination()
    logs = T.read_logs(spark, out)
    assert logs.count() == 10 == logs.select("log_id").distinct().count()
    store = str(tmp_path / "store")
    ingest_pending(spark, source, store, signatures)
    batch = T.read_logs(spark, f"{store}/logs")
    fields = ("timestamp", "ip", "user_agent", "ua_version", "os_code", "value_data", "order_data")
    shown = [sorted(str(r) for r in df.select(*fields).collect()) for df in (logs, batch)]
    assert shown[0] == shown[1]


def test_streamed_ids_never_overlap(spark, monkeypatch):
    monkeypatch.setattr(SI, "_BATCH_SHIFT", 33)  # room for four partitions
    lines = spark.range(1000).repartition(9)
    ids = [r["log_id"] for b in (0, 1, 2) for r in SI.number_lines(lines, b).collect()]
    assert len(set(ids)) == 3000 and max(i >> 33 for i in ids) == 2
    monkeypatch.setattr(SI, "_PART_SHIFT", 5)
    with pytest.raises(Exception, match="more lines than a log id has room for"):
        SI.number_lines(lines, 0).collect()
    with pytest.raises(OverflowError):
        SI.number_lines(lines, 1 << 30)


def test_stream_admits_by_bytes(spark, source, signatures, tmp_path):
    out = str(tmp_path / "out")
    stream_ingest(spark, source, out, f"{out}-checkpoint", signatures, batch_bytes=1).awaitTermination()
    logs = T.read_logs(spark, out)
    assert logs.count() == 8 == logs.select("log_id").distinct().count()
    assert spark.read.parquet(out).select("batch").distinct().count() == 2


def fixed_model(width, up):
    return FamilyModel(LinearScorer(["chrome", "x"], [up, -up], [[0.0, 0.0]] * width), None)


def test_versions_keep_model_and_vocabulary_together(spark, tmp_path):
    store = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        T.load_model(spark, store)
    for version, names in ((1, ["Accept=a"]), (2, ["Accept=a", "Accept=b"])):
        vocabulary = spark.createDataFrame(list(zip(names, range(9))), "feature_name string, idx int")
        assert T.save_model(spark, fixed_model(49 + version, version), vocabulary, store) == version
        model = T.load_model(spark, store)
        assert (model.version, model.width, model.vocabulary.table.count()) == (version, 49 + version, version)
        assert model.scorer.head.intercepts == [version, -version]
    # A version that was not published is not found.
    T.overwrite(fixed_model(60, 9).export_coefficients(spark), f"{store}/version=3/coefficients")
    assert T.load_model(spark, store).version == 2
    assert T.load_model(spark, store, version=1).width == 50


@pytest.mark.parametrize("bounds", [{}, {"max_rows": 0}])
def test_stream_frame_of_verdicts(spark, signatures, tmp_path, bounds):
    """Any sink, and weights of any number: a stream is scored in place, without groups."""
    store, source = str(tmp_path / "models"), str(tmp_path / "requests")
    vocabulary = spark.createDataFrame([("Accept=a", 0)], "feature_name string, idx int")
    T.save_model(spark, fixed_model(50, 1.0), vocabulary, store)
    body = f"Host: h\nAccept: a\nUser-Agent: {CHROME}".replace("\\", "")
    rows = [(i, "1.1.1.1", body if i % 2 else "") for i in range(10)]
    spark.createDataFrame(rows, Q.REQUESTS).write.parquet(source)
    model = T.load_model(spark, store)
    model = replace(model, scorer=TableScorer.from_table(model.coefficients, **bounds))
    assert model.scorer.tail.small == (not bounds)
    stream = verdict_stream(Q._stream_of(spark, source), signatures, model)
    assert stream.isStreaming
    query = stream.writeStream.format("memory").queryName("verdicts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["verdict"] for r in spark.table("verdicts").collect()] == ["human"] * 5


def test_retrained_model_believes_most_logs(spark, sf_dir, tmp_path):
    logs = Q._stored(spark, sf_dir)
    store = str(tmp_path / "models")
    assert retrain(spark, logs, store, n=300) == 1
    model = T.load_model(spark, store)
    assert os.path.isdir(f"{store}/version=1/one_vs_rest")
    humans = Q.V.judge_logs(logs, model.vocabulary, model.scorer)
    bots = Q.V.judge_logs(A.make_bot_sample(logs), model.vocabulary, model.scorer)
    rates = Q.V.error_rates(bots, humans).first()
    assert rates["error_1"] < 5


def test_shared_folder_comes_from_the_session(spark):
    from headersieve.session import fresh_path, shared_dir

    assert fresh_path(spark, "x").startswith(shared_dir(spark))
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
