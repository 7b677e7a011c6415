from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweir.plans import flows
from logweir.sources import tail
from logweir.sources.lines import stream_log
from logweir.streaming import live
from logweir.streaming import windows as W

KINDS = ["Receiving block {b} now", "Deleted {b} from disk", "Verified {b} ok today fine"]


def log(n, blocks=12):
    rows = []
    for i in range(n):
        b = f"blk_{(i * 7) % blocks}"
        level = "ERROR" if i % 29 == 0 else "INFO"
        rows.append(f"081109 {200000 + i} 1 {level} a.b: " + KINDS[i % 3].format(b=b))
    rows[5:5] = [f"081109 200005 1 ERROR a.b: lost replica of blk_3 on {k} hosts" for k in range(15)]
    return rows


def as_lines(spark, rows):
    return spark.createDataFrame([(i + 1, r) for i, r in enumerate(rows)], "line_id long, raw string")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 120), st.integers(1, 40))
def test_every_line_lands_in_one_window(spark, total, n):
    got = W.window_sizes(spark.range(1, total + 1).select(F.col("id").alias("line_id")), n).orderBy("window_index").collect()
    assert [r.window_index for r in got] == list(range(-(-total // n)))
    assert sum(r.lines_processed for r in got) == total and all(r.lines_processed == n for r in got[:-1])


def test_windows_are_detected_apart(spark):
    rows = log(100)
    ev, _ = flows.templated_events(as_lines(spark, rows), "hdfs")
    out = W.window_detect(ev, 40, 0.1, n_trees=30)
    got = out.collect()
    assert {r.window_index for r in got} == {0, 1, 2}
    first = [r for r in got if r.window_index == 0]
    assert min(first, key=lambda r: r.anomaly_score).block_id == "blk_3"
    assert all((r.incident_id >= 0) == r.is_anomaly for r in got)
    alone, _ = flows.templated_events(as_lines(spark, rows[:40]), "hdfs")
    again = {r.block_id: r.anomaly_score for r in W.window_detect(alone, 40, 0.1, n_trees=30).collect()}
    assert again.keys() == {r.block_id for r in first}
    res = W.window_results(as_lines(spark, rows), ev, out, 40).orderBy("window_index").collect()
    assert [r.lines_processed for r in res] == [40, 40, 35] and all(r.incident_count <= r.anomaly_count for r in res)


def test_equal_rows_of_a_window_go_down_once():
    """The same trees as with every row on its own, up to chance."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.repeat(np.vstack([rng.normal(size=(6, 3)), [[9, 9, 9]]]), [12, 1, 7, 9, 3, 5, 1], axis=0)
    once = W.window_scores(x, 3_000, 0)
    noisy = W.window_scores(x + rng.normal(size=x.shape) * 1e-9, 3_000, 0)  # no two rows are equal
    sample = np.repeat(x[None], 3_000, 0)
    every = -np.power(2.0, -W.path_lengths(x, *W.grow_trees(sample, 6, np.random.default_rng(5))) / W.mean_path([len(x)])[0])
    assert np.abs(once - every).max() < 0.01 and once.argmin() == noisy.argmin() == len(x) - 1


def test_one_block_is_not_detected(spark):
    ev, _ = flows.templated_events(as_lines(spark, log(20, blocks=1)[20:]), "hdfs")
    assert W.window_detect(ev, 50, n_trees=5).count() == 0


def test_shuffle_is_seeded_and_softly_limited(spark):
    df = as_lines(spark, log(120))
    a, b, c = (W.shuffled_blocks(df, 30, s).orderBy("pos").collect() for s in (1, 1, 2))
    assert a == b and [r.block_id for r in a] != [r.block_id for r in c]
    per = {}
    for r in a:
        per.setdefault(r.block_id, []).append(r.line_id)
    assert all(v == sorted(v) for v in per.values())
    assert [r.pos for r in a] == list(range(1, len(a) + 1))
    assert 30 <= len(a) and len(a) - len(list(per.values())[-1]) < 30


def test_lines_of_splits():
    """Each line is given by the split it begins in, wherever the cuts fall."""
    import pyarrow as pa

    data = "é first\n\nthird line is longer\nx\nlast without end".encode()
    f = pa.BufferReader(data)
    old = tail.BLOCK
    for block in (1, 3, 1 << 20):
        tail.BLOCK = block
        for step in range(1, len(data) + 1):
            got = [x for at in range(0, len(data), step) for x in tail.lines_from(f, 0, at, min(at + step, len(data)), len(data))]
            assert got == data.split(b"\n")
        low = data.index(b"third")
        for step in range(1, 20):
            got = [x for at in range(low, len(data), step) for x in tail.lines_from(f, low, at, min(at + step, len(data)), len(data))]
            assert got == data[low:].split(b"\n")
    tail.BLOCK = old


def run_tail(spark, src, out, checkpoint, **options):
    batches = []

    def keep(batch, batch_id):
        batches.append(sorted((r.path.rsplit("/", 1)[1], r.begin, r.raw) for r in batch.collect()))

    q = tail.tail_log(spark, str(src), **options).writeStream.option("checkpointLocation", str(checkpoint)).foreachBatch(keep)
    q.trigger(availableNow=True).start().awaitTermination()
    return [b for b in batches if b]


def test_appended_files_give_their_new_lines(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.log").write_bytes(b"one\n  two \n\nunfin")
    (src / ".hidden").write_text("no\n")
    args = (spark, src, tmp_path / "out", tmp_path / "chk")
    assert run_tail(*args, hold=1e6) == [[("a.log", 0, "one"), ("a.log", 0, "two")]]
    with open(src / "a.log", "ab") as f:
        f.write(b"ished\nfour \xff\n")
    (src / "b.log").write_text("bee")
    assert run_tail(*args, hold=1e6) == [[("a.log", 12, "four \ufffd"), ("a.log", 12, "unfinished")]]
    assert run_tail(*args, hold=-1.0) == [[("b.log", 0, "bee")]]  # settled
    assert run_tail(*args, hold=-1.0) == []


def test_splits_of_a_file_keep_dense_numbers(spark, tmp_path):
    from logweir.sources.lines import number_rows

    src = tmp_path / "in"
    src.mkdir()
    want = [f"line {i} x" + "y" * (i % 13) for i in range(200)]
    (src / "a.log").write_text("\n".join(want) + "\n")
    got = []

    def keep(batch, batch_id):
        rows = batch.select("path", F.col("begin").alias("_start"), "raw")
        got.extend((r.line_id, r.raw) for r in number_rows(rows, "line_id").collect())
        assert batch.select("begin").distinct().count() >= 3

    q = tail.tail_log(spark, str(src), split=900).writeStream.option("checkpointLocation", str(tmp_path / "chk")).foreachBatch(keep)
    q.trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == list(enumerate(want, 1))


def as_batch(spark, rows, path="s/a.log", begin=0):
    return spark.createDataFrame([("s", path, begin, r) for r in rows], "source string, path string, begin long, raw string").coalesce(1)


def test_windows_go_on_and_batches_repeat_safely(spark, tmp_path, monkeypatch):
    rows, store, out = log(100), str(tmp_path / "state"), str(tmp_path / "out")
    s = live.Settings(n=25, n_trees=10)

    def results():
        got = spark.read.parquet(f"{out}/windows").collect()
        return sorted((r.batch_id, r.source, r.window_index, r.lines_processed, r.events_parsed, r.anomaly_count) for r in got)

    def sizes(batch):
        return sorted((r.template, r["size"]) for r in spark.read.parquet(f"{store}/state/batch={batch}/templates").collect())

    live.process_batch(as_batch(spark, rows[:40]), 0, store, out, s)
    assert [r[:4] for r in results()] == [(0, "s", 0, 25)]
    one, first = sizes(0), results()
    live.process_batch(as_batch(spark, rows[:40]), 0, store, out, s)  # after it was published
    assert (sizes(0), results()) == (one, first)
    with monkeypatch.context() as m:  # killed just before it is published
        m.setattr(live, "publish", lambda *_: None)
        live.process_batch(as_batch(spark, rows[40:90], "s/b.log"), 1, store, out, s)
    live.process_batch(as_batch(spark, rows[40:90], "s/b.log"), 1, store, out, s)
    two = sizes(1)
    assert [r[:4] for r in results()] == [(0, "s", 0, 25), (1, "s", 1, 25), (1, "s", 2, 25)]
    assert sum(n for _, n in two) == 75
    live.process_batch(as_batch(spark, []), 2, store, out, s)
    live.process_batch(as_batch(spark, rows[90:], "s/c.log"), 3, store, out, s)
    assert [r[2:4] for r in results()] == [(0, 25), (1, 25), (2, 25), (3, 25)]
    rest, _ = live.trailing_windows(spark, store, s)
    assert [(r.window_index, r.lines_processed) for r in rest.collect()] == [(4, 15)]
    assert sum(n for _, n in sizes(3)) == 100
    # the windows of one batch that holds all
    live.process_batch(as_batch(spark, rows), 0, str(tmp_path / "s2"), str(tmp_path / "o2"), s)
    whole = spark.read.parquet(str(tmp_path / "o2" / "windows")).collect()
    assert sorted((r.window_index, r.lines_processed, r.events_parsed) for r in whole) == [r[2:5] for r in results()]


def test_stream_of_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.log").write_text("\n".join(log(60)) + "\n")
    s = live.Settings(n=25, n_trees=10)

    def run():
        q = live.stream_windows(tail.tail_log(spark, str(src)), str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "chk"), s)
        q.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.window_index, r.lines_processed) for r in spark.read.parquet(str(tmp_path / "out" / "windows")).collect())

    assert run() == [(0, 25), (1, 25), (2, 25)]
    (src / "b.log").write_text("\n".join(log(30)) + "\n")
    assert run() == [(i, 25) for i in range(4)]


def test_whole_files_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(" one\n\ntwo\n")
    q = stream_log(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c"))
    q.trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.line_id, r.raw) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [(1, "one"), (2, "two")]


def test_end_to_end_on_a_small_log(spark):
    d = flows.run_detect(as_lines(spark, log(150)), contamination=0.1, n_trees=50)
    t = d.totals().first()
    assert (t.total_lines, t.total_events, t.total_blocks, t.templates) == (165, 165, 12, 4)
    worst = d.blocks.orderBy("anomaly_score").first()
    assert worst.block_id == "blk_3" and worst.is_anomaly
    assert d.members.count() == t.anomalies and d.incidents.count() == t.incidents
    assert d.incident_lines.groupBy("incident_id").agg(F.max("line_no").alias("a"), F.count("*").alias("b")).where("a <> b").count() == 0


def test_no_incidents_no_calls(spark):
    def never(prompt):
        raise AssertionError

    found, out = flows.run_analyze(as_lines(spark, ["nothing here"] * 5), never, call_options={"retries": 1})
    assert out is None and found.incidents.count() == 0
