"""Log lines rendered from the events test table, in the SQL of either engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HDFS = """
select event_id + 1 as line_id,
 concat({hdfs_ts}, ' ', cast(user_id as {s}), ' ',
  case when event_type='error' and value >= 200 then 'FATAL' when event_type='error' then 'ERROR'
       when event_type='signup' then 'WARN' else 'INFO' end,
  ' dfs.', event_type, ': ', {body}) as raw
from (select *, concat('blk_', cast(user_id * 100 + day(ts) as {s})) as b from events) e
"""

_SSH = """
select event_id + 1 as line_id,
 concat({sys_ts}, ' host', cast(user_id % 7 as {s}), ' sshd[', cast(user_id * 100 + day(ts) as {s}), ']: ',
  {body}) as raw
from (select *, concat('blk_', cast(user_id * 100 + day(ts) as {s})) as b from events) e
"""

_SYSLOG = """
select event_id + 1 as line_id,
 concat({sys_ts}, ' host', cast(user_id % 7 as {s}), ' ', event_type,
  case when event_id % 3 = 0 then '' else concat('[', cast(user_id as {s}), ']') end, ': ',
  {body}) as raw
from (select *, concat('blk_', cast(user_id * 100 + day(ts) as {s})) as b from events) e
"""

_ISO = """
select event_id + 1 as line_id,
 concat({iso_ts}, ' ',
  case when event_type='error' then 'error' when event_type='signup' then 'Warning'
       when event_type='view' then 'CRITICAL' when event_type='click' then '' else 'INFO' end,
  ' [app.', event_type, '] request_id=', 'req', cast(10000 + user_id * 100 + day(ts) as {s}), ' ',
  {body}) as raw
from (select *, concat('blk_', cast(user_id * 100 + day(ts) as {s})) as b from events) e
"""

_BODY = """case event_type
   when 'view' then concat('Receiving block ', b, ' src: /10.0.0.', cast(user_id % 250 as {s}), ' dest: /10.0.1.', cast(user_id % 250 as {s}))
   when 'click' then concat('PacketResponder ', cast(event_id % 3 as {s}), ' for block ', b, ' terminating')
   when 'purchase' then concat('Received block ', b, ' of size ', cast(cast(floor(value) as bigint) as {s}), ' from /10.0.0.', cast(user_id % 250 as {s}))
   when 'signup' then concat('writeBlock ', b, ' received exception java.io.IOException: Could not read from stream')
   else concat('10.0.0.1:50010:DataXceiver: java.io.IOException: Connection reset by peer ', b) end"""

_SHAPES = {"hdfs": _HDFS, "openssh": _SSH, "syslog": _SYSLOG, "iso": _ISO}
_SPARK = {
    "s": "string",
    "hdfs_ts": "date_format(ts,'yyMMdd HHmmss')",
    "sys_ts": "date_format(ts,'MMM dd HH:mm:ss')",
    "iso_ts": "date_format(ts,\"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
}
_DUCK = {
    "s": "varchar",
    "hdfs_ts": "strftime(ts,'%y%m%d %H%M%S')",
    "sys_ts": "strftime(ts,'%b %d %H:%M:%S')",
    "iso_ts": "strftime(ts,'%Y-%m-%dT%H:%M:%SZ')",
}


def _text(shape: str, engine: dict[str, str]) -> str:
    body = _BODY.format(**engine)
    return _SHAPES[shape].format(body=body, **engine)


def lines_sql(shape: str = "hdfs") -> str:
    """The rendering as DuckDB SQL."""
    return _text(shape, _DUCK)


def rendered_lines(spark: SparkSession, sf_dir: str, shape: str = "hdfs") -> DataFrame:
    """(line_id, raw) rendered from the events table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cores = spark.sparkContext.defaultParallelism
    if events.rdd.getNumPartitions() < cores:  # a small table is one split
        events = events.repartition(cores)
    return spark.sql(_text(shape, _SPARK).replace("from events)", "from {ev})"), ev=events).select(
        F.col("line_id").cast("long"), "raw"
    )
