import json
import os
import time

from pyspark.sql import functions as F

from logweir.operators.features import feature_space, sparse_features
from logweir.operators.iforest import IForest
from logweir.sources import lines as L
from logweir.sources import stores


def test_dense_line_ids_over_splits_and_files(spark, tmp_path):
    want = []
    for f in range(3):
        kept = [f"file{f} line {i} " + "x" * (i % 17) for i in range(200)]
        want += kept
        text = "".join(f"  {k}\t\n" + ("\n   \n" if i % 3 == 0 else "") for i, k in enumerate(kept))
        (tmp_path / f"f{f}.log").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = L.scan_log(spark, str(tmp_path), "global").orderBy("line_id").collect()
        per_file = L.scan_log(spark, str(tmp_path)).groupBy("path").agg(F.min("line_id"), F.max("line_id"), F.count_distinct("line_id")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.line_id for r in got] == list(range(1, 601))
    assert [r.raw for r in got] == [w.strip() for w in want]
    assert all(tuple(r)[1:] == (1, 200, 200) for r in per_file)


def test_bad_bytes_are_replaced(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"ok \xff\xfe end\n\n\x85odd\n")
    raw = [r.raw for r in L.scan_log(spark, str(tmp_path / "a.log")).orderBy("line_id").collect()]
    assert raw[0].startswith("ok �") and raw[0].endswith(" end") and len(raw) == 2


def test_explode_text(spark):
    df = spark.createDataFrame([(1, " a \r\n\n b\rc \n")], "id long, t string")
    assert [tuple(r) for r in L.explode_text(df, "t", "id").orderBy("line_id").collect()] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c")]


def test_labels_last_duplicate_wins(spark, tmp_path):
    p = tmp_path / "labels.csv"
    p.write_text("BlockId,Label\nblk_1,Normal\n blk_2 , Anomaly \n,Anomaly\nblk_1,Anomaly\nblk_3,anomaly\n")
    got = {r.block_id: r.is_anomaly for r in L.scan_labels(spark, str(p)).collect()}
    assert got == {"blk_1": True, "blk_2": True, "blk_3": False}


def test_template_catalog(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('EventId,EventTemplate\nE1,"Got [*] (x+y), done"\nE2,Stop [*]\n')
    rows = L.scan_templates(spark, str(p)).orderBy("idx").collect()
    assert [r.idx for r in rows] == [0, 1]
    df = spark.createDataFrame([("GOT 12 (X+Y), done.",), ("Got 12 xxy, done",)], "c string")
    assert [r[0] for r in df.select(F.col("c").rlike(rows[0].regex)).collect()] == [True, False]


def test_incident_documents_get_defaults(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps({"incidents": [{"incident_id": 3, "mean_anomaly_score": -0.2, "block_ids": ["b"]}, {}]}, indent=1))
    a, b = L.scan_incidents(spark, str(p)).orderBy(F.desc("incident_id")).collect()
    assert (a.incident_id, a.anomaly_scores, a.block_ids, a.log_lines) == (3, [-0.2], ["b"], [])
    assert (b.incident_id, b.severity, b.anomaly_scores, b.time_range.start) == (0, 0.0, [0.0], "")


LINE = "081109 203518 1 INFO a.b: Receiving block blk_{} now\n"


SSHD = "Jun 14 15:16:01 box sshd[{}]: Failed password for root from 10.0.0.1 port 22\n"
ISO = "2024-01-02T03:04:05Z error [app.main] request_id=req{} gave up\n"


def levels(ev):
    return {(os.path.basename(r.path), r.format, r.level, r.block_id): r["count"] for r in ev.groupBy("path", "format", "level", "block_id").count().collect()}


def test_refresh_parses_only_changed_files(spark, tmp_path):
    src, store = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    (src / "a.log").write_text(LINE.format(1) * 3)
    assert stores.refresh_events(spark, str(src), store, "hdfs").count() == 3
    (src / "b.log").write_text(LINE.format(2))
    assert stores.refresh_events(spark, str(src), store, "hdfs").count() == 4
    versions = [d for d in os.listdir(f"{store}/events") if d.startswith("version=")]
    assert stores.refresh_events(spark, str(src), store, "hdfs").count() == 4
    assert sorted(d for d in os.listdir(f"{store}/events") if d.startswith("version=")) == sorted(versions)
    time.sleep(1.1)
    (src / "a.log").write_text(LINE.format(1) * 5)
    got = stores.refresh_events(spark, str(src), store, "hdfs")
    assert {r.block_id: r["count"] for r in got.groupBy("block_id").count().collect()} == {"blk_1": 5, "blk_2": 1}
    assert stores.refresh_events(spark, str(src), store, "hdfs", force=True).count() == 6
    (src / "b.log").unlink()
    assert stores.refresh_events(spark, str(src), store, "hdfs").count() == 5
    (src / "a.log").unlink()
    (src / "empty.log").write_text("")
    assert stores.refresh_events(spark, str(src), store).count() == 0


def test_each_file_of_a_folder_has_its_format(spark, tmp_path):
    """Nine files of one kind do not hide the tenth and eleventh."""
    src, store = tmp_path / "src", str(tmp_path / "store")
    (src / "deep").mkdir(parents=True)
    for i in range(9):
        (src / f"h{i}.log").write_text(LINE.format(i) * 40)
    (src / "deep" / "s.log").write_text("not sshd\n" + SSHD.format(7) * 29)
    (src / "i.log").write_text(ISO.format(12345) * 25 + "plain words\n")
    (src / "short.log").write_text("only words here\n")
    got = levels(stores.refresh_events(spark, str(src), store))
    want = {(f"h{i}.log", "hdfs", "INFO", f"blk_{i}"): 40 for i in range(9)}
    want |= {("s.log", "openssh", "UNKNOWN", "7"): 29, ("i.log", "generic", "ERROR", "req12345"): 25}
    want |= {("i.log", "generic", "UNKNOWN", ""): 1, ("short.log", "generic", "UNKNOWN", ""): 1}
    assert got == want
    assert levels(stores.read_events(spark, store)) == want


def test_a_failed_refresh_shows_nothing(spark, tmp_path, monkeypatch):
    src, store = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    (src / "a.log").write_text(LINE.format(1) * 3)
    (src / "b.log").write_text(LINE.format(2) * 2)
    before = levels(stores.refresh_events(spark, str(src), store))
    time.sleep(1.1)
    (src / "a.log").write_text(SSHD.format(5) * 4)
    (src / "b.log").unlink()

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(stores, "publish", killed)
        try:
            stores.refresh_events(spark, str(src), store)
        except KeyboardInterrupt:
            pass
    assert levels(stores.read_events(spark, store)) == before
    after = {("a.log", "openssh", "UNKNOWN", "5"): 4}
    assert levels(stores.refresh_events(spark, str(src), store)) == after == levels(stores.read_events(spark, store))


def test_events_of_files_equal_those_of_single_logs(spark, tmp_path):
    from logweir.operators.parse import parse_each_file, parse_lines

    kinds = {"h": LINE, "s": SSHD, "i": ISO}
    for k, line in kinds.items():
        (tmp_path / f"{k}.log").write_text("".join(line.format(10_000 + i) for i in range(30)) + "odd one\n")
    cols = ["line_id", "timestamp", "level", "component", "content", "block_id"]
    ev = parse_each_file(L.scan_log(spark, str(tmp_path)))
    for k in kinds:
        alone = parse_lines(L.scan_log(spark, str(tmp_path / f"{k}.log")), "auto").select(*cols)
        assert sorted(alone.collect()) == sorted(ev.where(F.col("path").endswith(f"/{k}.log")).select(*cols).collect())


def test_detection_over_files_of_several_formats(spark, tmp_path):
    from logweir.plans.flows import templated_events

    (tmp_path / "a.log").write_text("".join(LINE.format(i) for i in range(30)))
    (tmp_path / "b.log").write_text("".join(SSHD.format(i) for i in range(25)))
    ev, tpl = templated_events(L.scan_log(spark, str(tmp_path), "both"))
    names = {r.template_id: r.template for r in tpl.collect()}
    assert sorted(names) == [1, 2] and names[1] == "Receiving block <*> now" and names[2].startswith("Failed password for root")
    assert {(r.format, r.template_id): r["count"] for r in ev.groupBy("format", "template_id").count().collect()} == {("hdfs", 1): 30, ("openssh", 2): 25}
    assert ev.agg(F.count_distinct("line_id")).first()[0] == 55


def test_template_store_versions_and_clear(spark, tmp_path):
    p = str(tmp_path / "tpl")
    assert stores.load_templates(spark, p) is None
    cols = "template_id long, tokens array<string>, template string, size long, first_line long"
    stores.save_templates(spark.createDataFrame([(1, ["a"], "a", 1, 1)], cols), p)
    stores.save_templates(spark.createDataFrame([(1, ["a"], "a", 2, 1), (2, ["b"], "b", 1, 5)], cols), p)
    assert stores.load_templates(spark, p).count() == 2
    stores.clear_templates(spark, p)
    left = stores.load_templates(spark, p)
    assert left is None or left.where("template_id is not null").count() == 0


def test_model_round_trip(spark, make_events, tmp_path):
    ev = make_events([(i, f"b{i % 40}", i % 3) for i in range(400)])
    space = feature_space(ev)
    blk = sparse_features(ev, space)
    model, decided = IForest(20, 0.1).fit_decide(blk)
    tpl = spark.createDataFrame([(0, ["a"], "a", 1, 1)], "template_id long, tokens array<string>, template string, size long, first_line long")
    stores.save_model(model, space, tpl, str(tmp_path / "m"), "forest", "r1")
    back, space2, _ = stores.load_model(spark, str(tmp_path / "m"))
    a = {r.block_id: r.anomaly_score for r in decided.collect()}
    b = {r.block_id: r.anomaly_score for r in back.decide(sparse_features(ev, space2)).collect()}
    assert a == b and len(a) == 40
    info = stores.model_info(spark, str(tmp_path / "m")).first()
    assert (info.model_name, info.run_id, info.vocab_size, info.model_type) == ("forest", "r1", 3, "Forest")


def test_vocab_documents_old_and_new(spark, tmp_path):
    (tmp_path / "old.json").write_text("[3, 5, 9]")
    (tmp_path / "new.json").write_text('{"template_vocab": [1, 2], "feature_set": "freq_only"}')
    old, new = (stores.load_vocab_json(spark, str(tmp_path / n)) for n in ("old.json", "new.json"))
    assert (old.size, old.feature_set, new.size, new.feature_set) == (3, "full", 2, "freq_only")
    assert [tuple(r) for r in old.vocab.orderBy("col").collect()] == [(3, 0), (5, 1), (9, 2)]


def test_runs_table(spark, tmp_path):
    p = str(tmp_path / "runs")
    stores.append_run(spark, p, "detection", {"contamination": 0.03}, {"f1": 0.5}, "r1")
    stores.append_run(spark, p, "detection", {}, {"f1": 0.7}, "r2")
    runs = {r.run_id: r for r in stores.read_runs(spark, p, ["contamination"], ["f1"]).collect()}
    assert runs["r1"].contamination == "0.03" and runs["r2"].contamination is None and runs["r2"].f1 == 0.7


def test_runs_know_their_input(spark, tmp_path):
    p, df = str(tmp_path / "runs"), spark.createDataFrame([(1, "a", None), (2, "b", {"k": 1})], "i int, s string, m map<string,int>")
    a, b = stores.fingerprint(df), stores.fingerprint(df.orderBy("s", ascending=False).repartition(3))
    assert a == b and a["input_rows"] == "2" and a["input_hash"] != stores.fingerprint(df.where("i = 1"))["input_hash"]
    assert stores.fingerprint(df.limit(0))["input_hash"] == "0" * 32
    stores.append_run(spark, p, "detection", {"c": 1}, {}, "r1", df)
    row = stores.read_runs(spark, p, ["input_rows", "input_hash", "c"], []).first()
    assert (row.input_rows, row.input_hash, row.c) == ("2", a["input_hash"], "1")


def test_scratch_tables_go(spark):
    from logweir.session import materialize, scratch, work_dir

    base = work_dir(spark)
    with scratch(spark) as folder:
        assert materialize(spark.range(5), "inside").count() == 5 and os.listdir(folder.replace("file:", ""))
    assert not os.path.exists(folder.replace("file:", "")) and work_dir(spark) == base
    try:
        with scratch(spark) as folder:
            materialize(spark.range(5), "inside")
            raise ValueError
    except ValueError:
        assert not os.path.exists(folder.replace("file:", ""))
