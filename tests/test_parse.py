import pytest
from pyspark.sql import functions as F

from logweir.functions import text as X
from logweir.operators import formats as FM
from logweir.operators import parse as P

HDFS = "081109 203518 143 INFO dfs.DataNode$Receiver: Receiving block blk_-42 src: /10.0.0.1:54106"
SSH = "Dec 10 06:55:46 box sshd[24200]: Invalid user guest from 10.0.0.9"
SYSLOG = "Jun  9 06:06:20 box syslogd 1.4.1: restart"


def lines(spark, *raw):
    return spark.createDataFrame([(i + 1, r) for i, r in enumerate(raw)], "line_id long, raw string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_hdfs_fields(spark):
    r = one(P.parse_lines(lines(spark, HDFS), "hdfs"))
    assert (r.timestamp, r.level, r.component, r.block_id) == ("081109 203518", "INFO", "dfs.DataNode$Receiver", "blk_-42")
    assert r.content == "Receiving block blk_-42 src: /10.0.0.1:54106"


def test_openssh_entity_is_the_pid_of_the_whole_line(spark):
    r = one(P.parse_lines(lines(spark, SSH), "openssh"))
    assert (r.timestamp, r.component, r.block_id, r.level) == ("Dec 10 06:55:46", "box", "24200", "UNKNOWN")


def test_syslog_pid_is_optional(spark):
    rows = P.parse_lines(lines(spark, "Jun  9 06:06:20 box cron[99]: job", SYSLOG), "syslog").orderBy("line_id").collect()
    assert [(r.component, r.content, r.block_id) for r in rows] == [("cron", "job", ""), ("syslogd 1.4.1", "restart", "")]


@pytest.mark.parametrize(
    "raw, timestamp, level, component, content",
    [
        ("2024-03-17T10:23:45.123Z ERROR [web.api] it broke", "2024-03-17T10:23:45.123Z", "ERROR", "web.api", "[web.api] it broke"),
        ("1710672225 nginx: up now", "1710672225", "UNKNOWN", "nginx", "nginx: up now"),
        ("WARNING low disk", "", "WARNING", "", "low disk"),
        ("INFO", "", "INFO", "", "INFO"),
        ("plain words only", "", "UNKNOWN", "", "plain words only"),
        ("17/Mar/2024:10:23:45 worker[12]: done", "17/Mar/2024:10:23:45", "UNKNOWN", "worker", "worker[12]: done"),
        ("081109 203518 information only", "081109 203518", "UNKNOWN", "", "information only"),
    ],
)
def test_generic_fields(spark, raw, timestamp, level, component, content):
    r = one(P.generic_fields(lines(spark, raw)))
    assert (r.timestamp, r.level, r.component, r.content) == (timestamp, level, component, content)


def test_levels_outside_the_enum_become_unknown(spark):
    df = spark.createDataFrame([("warn",), ("WARNING",), ("critical",), ("Fatal",)], "l string")
    assert [r[0] for r in df.select(X.norm_level(F.col("l"))).collect()] == ["WARN", "UNKNOWN", "UNKNOWN", "FATAL"]


def test_named_format_drops_and_counts_bad_lines(spark):
    df = lines(spark, HDFS, "nonsense", HDFS)
    assert P.parse_lines(df, "hdfs").count() == 2
    assert tuple(one(P.parse_errors(df, FM.HDFS))) == (3, 2, 1)


def test_unknown_format_raises(spark):
    with pytest.raises(ValueError):
        P.parse_lines(lines(spark, HDFS), "nope")


def test_format_detection(spark):
    assert FM.detect_format(lines(spark, *[HDFS] * 4, "x")) == "hdfs"
    assert FM.detect_format(lines(spark, *[HDFS] * 3, "x")) is None
    assert FM.detect_format(lines(spark, *[SSH] * 20, *["x"] * 50)) == "openssh"  # only the head counts, ties by order
    assert FM.detect_format(lines(spark, SYSLOG)) == "syslog"


def test_entity_detection(spark):
    uuid = "id 123e4567-e89b-12d3-a456-426614174000 ok"
    req = "request_id=abcdefgh1 ok"
    assert FM.detect_entity(lines(spark, uuid, "a", "b")) == X.ENTITY_SHAPES[0]
    assert FM.detect_entity(lines(spark, req, "a", "b", "c")) is None
    r = one(P.parse_lines(lines(spark, req)).select("block_id"))
    assert r.block_id == "abcdefgh1"


def test_first_matching_line_fixes_the_format(spark):
    df = P.parse_first_match(lines(spark, "starting up", HDFS, "garbage", HDFS)).orderBy("line_id")
    assert [(r.line_id, r.block_id) for r in df.collect()] == [(1, ""), (2, "blk_-42"), (4, "blk_-42")]


def test_signature_and_params(spark):
    df = spark.createDataFrame([(" took  15ms for blk_7 ok ", "took <*> for <*> ok extra")], "c string, t string")
    r = df.select(X.signature(F.col("c")).alias("s"), X.params(F.col("c"), F.col("t")).alias("p")).first()
    assert r.s == "took <*> for <*> ok" and r.p == ["15ms", "blk_7"]


def test_strip_prefix(spark):
    df = spark.createDataFrame([("a b c d e f",), ("a b c d",), ("a  b c d  e",)], "r string")
    assert [r[0] for r in df.select(X.strip_prefix(F.col("r"))).collect()] == ["e f", "a b c d", "e"]


def test_fences(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('{"a": 1}',), ("  ```\nx\n ``` \ny",)], "r string")
    assert [r[0] for r in df.select(X.strip_fence(F.col("r"))).collect()] == ['{"a": 1}', '{"a": 1}', "x\ny"]
