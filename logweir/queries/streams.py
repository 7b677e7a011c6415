"""Count windows, replay samples and streams (I)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from logweir.queries.base import lines, query, r6, tevents, with_
from logweir.session import materialize, work_dir
from logweir.sources.lines import number_rows
from logweir.sources.tail import tail_log
from logweir.streaming import live
from logweir.streaming import windows as W

N = W.WINDOW


@query("count_windows", with_("lines", f"""
  select (line_id - 1) // {N} as window_index, count(*) as lines_processed, min(line_id) as first_line, max(line_id) as last_line
  from lines group by 1"""))
def count_windows(spark, sf):
    return W.window_sizes(lines(spark, sf))


_STATS = f"""select (line_id - 1) // {N} as window_index, count(*) as lines_processed, count(*) as events_parsed,
  count(distinct nullif(block_id, '')) as blocks, count(*) filter (where level in ('ERROR','FATAL')) as error_lines from ev group by 1"""


@query("window_stats", with_("ev", _STATS))
def window_stats(spark, sf):
    return W.window_stats(lines(spark, sf), tevents(spark, sf))


@query("window_min_blocks", with_("ev", """
  select (line_id - 1) // 3 as window_index, count(distinct block_id) as blocks from ev where block_id <> '' group by 1
  having count(distinct block_id) >= 3"""))
def window_min_blocks(spark, sf):
    """Windows of three lines in which every line has its own block."""
    return W.window_min_blocks(tevents(spark, sf), 3, least=3)


@query("window_detect")
def window_detect(spark, sf):
    return r6(W.window_detect(tevents(spark, sf)))


_TOTALS = f"""
  select window_index, cast(sum(events_parsed) over w as bigint) as total_events, cast(sum(hot) over w as bigint) as total_anomalies,
    cast(sum(coalesce(fresh, 0)) over w as bigint) as templates_seen
  from (select (line_id - 1) // {N} as window_index, count(*) as events_parsed, count(*) filter (where level = 'FATAL') as hot from ev group by 1) x
  left join (select (first_line - 1) // {N} as window_index, count(*) as fresh from tpl group by 1) y using (window_index)
  window w as (order by window_index rows unbounded preceding)"""


@query("running_totals", with_("tev", _TOTALS))
def running_totals(spark, sf):
    """Running totals with FATAL lines standing for anomalies."""
    ev = tevents(spark, sf)
    win = W.count_windows(ev).groupBy("window_index").agg(
        F.count("*").alias("events_parsed"), F.count_if(F.col("level") == "FATAL").alias("anomaly_count")
    )
    return W.running_totals(win, W.first_windows(ev))


@query("block_shuffle_sample", with_("ev", """
  select row_number() over (order by h, line_id) as pos, block_id, line_id, raw from (
    select e.*, s.h from ev e join (
      select block_id, n, md5('7:' || block_id) as h, sum(n) over (order by md5('7:' || block_id) rows unbounded preceding) as upto
      from (select block_id, count(*) as n from ev group by block_id) c) s using (block_id)
    where s.upto - s.n < 100) x"""))
def block_shuffle_sample(spark, sf):
    return W.shuffled_blocks(lines(spark, sf), 100, 7)


def _folder(spark, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _append(spark, sf, src: str, low: int, high: int) -> None:
    """The lines of a range as files of a folder, in line order."""
    rows = lines(spark, sf).where(F.col("line_id").between(low, high)).repartitionByRange(3, "line_id").sortWithinPartitions("line_id")
    rows.select(F.concat(F.lit("  "), "raw", F.when(F.col("line_id") % 5 == 0, "\n   ").otherwise("")).alias("value")).write.mode("append").text(src)


def _run(query) -> None:
    query.trigger(availableNow=True).start().awaitTermination()


@query("stream_log_source", with_("lines", "select line_id, raw, case when line_id <= (select max(line_id) // 2 from lines) then 0 else 1 end as batch from lines"))
def stream_log_source(spark, sf):
    """Every line of a growing folder through the streaming source, in two batches and many splits."""
    src, out, checkpoint = (_folder(spark, n) for n in ("grown", "streamed", "offsets"))
    total = lines(spark, sf).agg(F.max("line_id")).first()[0]

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    for low, high in ((1, total // 2), (total // 2 + 1, total)):
        _append(spark, sf, src, low, high)
        _run(tail_log(spark, src, split=100_000).writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep))
    got = spark.read.parquet(out)
    numbered = number_rows(got.select(F.col("source").alias("path"), F.struct("batch", "path", "begin").alias("_start"), "raw", "batch"), "line_id")
    return numbered.select("line_id", "raw", "batch")


@query("stream_count_windows", with_("ev", _STATS))
def stream_count_windows(spark, sf):
    """A growing log as a stream: its windows go on over files and batches; the last one is not full."""
    src, store, out, checkpoint = (_folder(spark, n) for n in ("grown", "state", "live", "offsets"))
    total = lines(spark, sf).agg(F.max("line_id")).first()[0]
    for low, high in ((1, total // 3), (total // 3 + 1, total)):
        _append(spark, sf, src, low, high)
        _run(live.stream_windows(tail_log(spark, src), store, out, checkpoint))
    rest, _ = live.trailing_windows(spark, store)
    cols = ["window_index", "lines_processed", "events_parsed", "blocks", "error_lines"]
    return materialize(spark.read.parquet(f"{out}/windows").select(*cols).unionByName(rest.select(*cols)), "windows")
