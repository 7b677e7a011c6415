"""Sources and line parsing (A, B)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions import text as X
from logweir.operators import formats as FM
from logweir.operators import parse as P
from logweir.operators import templates as TP
from logweir.queries.base import BL, CTE, HDFS, LEVELS, events, lines, query, table, tevents, wide_table, with_
from logweir.session import materialize, work_dir
from logweir.sources import lines as L
from logweir.sources import stores
from logweir.sources.render import lines_sql


def fresh(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written_lines(spark: SparkSession, sf: str) -> str:
    """The rendered log as text files in line order, every 5th line followed by
    a blank one and lines padded with blanks."""
    path = fresh(spark, "log")
    padded = F.concat(F.lit("  "), "raw", F.lit(" \t"), F.when(F.col("line_id") % 5 == 0, "\n   ").otherwise(""))
    rows = lines(spark, sf).repartitionByRange(4, "line_id").sortWithinPartitions("line_id")
    rows.select(padded.alias("value")).write.text(path)
    return path


@query("scan_log_lines", f"select line_id, raw from ({CTE['lines']}) l")
def scan_log_lines(spark, sf):
    return L.scan_log(spark, written_lines(spark, sf), "global").select("line_id", "raw")


_DOC_LINES = f"""
  select doc_id, unnest(l) as raw, unnest(generate_series(1, len(l))) as line_id from (
    select doc_id, list_filter(list_transform(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda x: trim(x, {BL})), lambda x: x <> '') as l
    from documents) d"""


@query("explode_log_text", f"select doc_id, line_id, raw from ({_DOC_LINES}) t")
def explode_log_text(spark, sf):
    return L.explode_text(wide_table(spark, sf, "documents"), "text", "doc_id")


@query("scan_labels", with_("ev", """
  select block_id, max_by(level in ('ERROR','FATAL'), line_id) as is_anomaly from ev where block_id <> '' group by block_id"""))
def scan_labels(spark, sf):
    """One label row per line, so blocks repeat and the last one counts."""
    path = fresh(spark, "labels")
    lab = F.when(F.col("level").isin("ERROR", "FATAL"), "Anomaly").otherwise("Normal")
    rows = events(spark, sf).select(
        "line_id", F.concat(F.lit(" "), "block_id").alias("BlockId"), F.concat(lab, F.lit(" ")).alias("Label")
    ).repartitionByRange(4, "line_id").sortWithinPartitions("line_id").drop("line_id")
    rows.write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, header=True)
    return L.scan_labels(spark, path)


_REGEX = r"""concat('(?i)(?d)', replace(regexp_replace(t, '([.^$*+?{}\[\]\\|()\-&~#\s])', '\\\1', 'g'), '\[\*\]', '.*'))"""


@query("scan_template_catalog", with_("tpl", f"""
  select template_id - 1 as idx, {_REGEX} as regex from (select template_id, replace(template, '<*>', '[*]') as t from tpl) x"""))
def scan_template_catalog(spark, sf):
    path = fresh(spark, "catalog")
    tpl = TP.number_templates(TP.with_signature(events(spark, sf)))
    rows = tpl.select(
        "template_id", F.concat(F.lit("E"), "template_id").alias("EventId"),
        F.replace("template", F.lit("<*>"), F.lit("[*]")).alias("EventTemplate"),
    )
    rows.repartitionByRange(2, "template_id").sortWithinPartitions("template_id").drop("template_id").write.csv(
        path, header=True
    )
    return L.scan_templates(spark, path)


# -- parsing -----------------------------------------------------------------

_EV_COLS = "line_id, timestamp, level, component, content, block_id"


@query("parse_hdfs", with_("ev", f"select {_EV_COLS} from ev"))
def parse_hdfs(spark, sf):
    return events(spark, sf).select(*_EV_COLS.split(", "))


_SSH = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+sshd\[(\d+)\]:\s+(.+)$"


@query("parse_openssh", f"""
  select line_id, regexp_extract(raw, '{_SSH}', 1) as timestamp, 'UNKNOWN' as level,
    regexp_extract(raw, '{_SSH}', 2) as component, regexp_extract(raw, '{_SSH}', 4) as content,
    coalesce(nullif(regexp_extract(regexp_extract(raw, '{_SSH}', 4), 'sshd\\[(\\d+)\\]', 1), ''),
             regexp_extract(raw, 'sshd\\[(\\d+)\\]', 1)) as block_id
  from ({lines_sql('openssh')}) l where regexp_matches(raw, '{_SSH}')""")
def parse_openssh(spark, sf):
    return P.parse_lines(lines(spark, sf, "openssh"), "openssh").select(*_EV_COLS.split(", "))


_SYS = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\[:]+)(?:\[(\d+)\])?:\s+(.+)$"


@query("parse_syslog", f"""
  select line_id, regexp_extract(raw, '{_SYS}', 1) as timestamp, 'UNKNOWN' as level,
    regexp_extract(raw, '{_SYS}', 3) as component, regexp_extract(raw, '{_SYS}', 5) as content, '' as block_id
  from ({lines_sql('syslog')}) l where regexp_matches(raw, '{_SYS}')""")
def parse_syslog(spark, sf):
    return P.parse_lines(lines(spark, sf, "syslog"), "syslog").select(*_EV_COLS.split(", "))


# The generic steps as SQL over a relation (k, raw)
_TS = X.TIMESTAMP_ANY
_LV = rf"(?i)\b({X.LEVEL_WORDS})\b"


def _generic_sql(src: str, keep: str) -> str:
    c1, c2, c3 = X.COMPONENT_SHAPES
    return f"""
      with src as ({src}),
      a as (select *, regexp_extract(raw, '{_TS}', 1) as timestamp, regexp_replace(raw, '{_TS}', '') as rest from src),
      b as (select *, coalesce(nullif(upper(regexp_extract(rest, '{_LV}', 1)), ''), 'UNKNOWN') as lvl,
        case when regexp_matches(rest, '{_LV}') then trim(regexp_replace(rest, '{_LV}', ''), {BL}) else rest end as cut from a),
      c as (select *, coalesce(nullif(regexp_extract(cut, '{c1}', 1), ''), nullif(regexp_extract(cut, '{c2}', 1), ''),
          nullif(regexp_extract(cut, '{c3}', 1), ''), '') as component,
        case when trim(cut, {BL}) = '' then raw else trim(cut, {BL}) end as content from b)
      select {keep} from c"""


_ALL = f"select 0 as src, doc_id as k, line_id, raw from ({_DOC_LINES}) t union all select 1, 0, line_id, raw from ({lines_sql('iso')}) l"


def mixed_lines(spark, sf) -> DataFrame:
    """Prose lines of the documents and ISO-stamped log lines."""
    docs = L.explode_text(wide_table(spark, sf, "documents"), "text", "doc_id")
    a = docs.select(F.lit(0).alias("src"), F.col("doc_id").alias("k"), "line_id", "raw")
    b = lines(spark, sf, "iso").select(F.lit(1).alias("src"), F.lit(0).cast("long").alias("k"), "line_id", "raw")
    return a.unionByName(b)


@query("parse_generic", _generic_sql(_ALL, f"""src, k, line_id, timestamp,
  case when lvl in {LEVELS} then lvl else 'UNKNOWN' end as level, component, content"""))
def parse_generic(spark, sf):
    return P.parse_lines(mixed_lines(spark, sf), "generic").select(
        "src", "k", "line_id", "timestamp", "level", "component", "content"
    )


_SHAPED = " union all ".join(
    f"select {i} as src, line_id as k, line_id, raw from ({lines_sql(s)}) l{i}" for i, s in enumerate(("hdfs", "openssh", "iso"))
)


def shaped_lines(spark, sf) -> DataFrame:
    parts = [
        lines(spark, sf, s).select(F.lit(i).alias("src"), F.col("line_id").alias("k"), "line_id", "raw")
        for i, s in enumerate(("hdfs", "openssh", "iso"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("extract_timestamp", _generic_sql(_SHAPED, "src, line_id, timestamp, rest"))
def extract_timestamp(spark, sf):
    raw = F.col("raw")
    return shaped_lines(spark, sf).select(
        "src", "line_id", X.generic_ts(raw).alias("timestamp"), X.after_ts(raw).alias("rest")
    )


@query("extract_level", _generic_sql(_SHAPED, "src, line_id, lvl as level, cut"))
def extract_level(spark, sf):
    rest = X.after_ts(F.col("raw"))
    return shaped_lines(spark, sf).select(
        "src", "line_id", X.generic_level(rest).alias("level"), X.after_level(rest).alias("cut")
    )


@query("extract_component", _generic_sql(_SHAPED, "src, line_id, component"))
def extract_component(spark, sf):
    return P.generic_fields(shaped_lines(spark, sf)).select("src", "line_id", "component")


_BARE = """select event_id + 1 as line_id, 0 as src, 0 as k, case when event_type = 'error' then 'ERROR'
  when event_type = 'signup' then concat('2024-01-01T00:00:00Z WARN  ') else props end as raw from events"""


@query("content_fallback", _generic_sql(_BARE, "line_id, raw, content"))
def content_fallback(spark, sf):
    """Lines that are nothing but a stamp and a level keep their whole text."""
    ev = table(spark, sf, "events")
    raw = (
        F.when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "signup", "2024-01-01T00:00:00Z WARN  ").otherwise(F.col("props"))
    )
    src = ev.select((F.col("event_id") + 1).alias("line_id"), raw.alias("raw"))
    return P.generic_fields(src).select("line_id", "raw", "content")


@query("normalize_level", f"""
  select event_id, case when upper(l) in {LEVELS} then upper(l) else 'UNKNOWN' end as level from (
    select event_id, case event_id % 6 when 0 then 'warning' when 1 then 'Critical' when 2 then 'fatal'
      when 3 then event_type when 4 then 'Info' else 'DEBUG' end as l from events) e""")
def normalize_level(spark, sf):
    m = F.col("event_id") % 6
    raw = (
        F.when(m == 0, "warning").when(m == 1, "Critical").when(m == 2, "fatal")
        .when(m == 3, F.col("event_type")).when(m == 4, "Info").otherwise("DEBUG")
    )
    return table(spark, sf, "events").select("event_id", X.norm_level(raw).alias("level"))


@query("compose_timestamp", with_("ev", "select timestamp, count(*) as n from ev group by timestamp"))
def compose_timestamp(spark, sf):
    return events(spark, sf).groupBy("timestamp").agg(F.count("*").alias("n"))


@query("extract_entity", with_("ev", r"""
  select line_id, block_id, regexp_extract(raw, '\d{6} (\d+)', 1) as pid from ev"""))
def extract_entity(spark, sf):
    """The block id sits in the content; the pid is only on the whole line."""
    return events(spark, sf).select(
        "line_id", X.entity(F.col("content"), F.col("raw"), FM.HDFS.entity).alias("block_id"),
        X.entity(F.lit(""), F.col("raw"), r"\d{6} (\d+)").alias("pid"),
    )


_REQ = X.ENTITY_SHAPES[1]


@query("extract_entity_generic", f"""
  select line_id, regexp_extract(raw, '{_REQ}', 1) as request_id,
    regexp_extract(raw, 'blk_[0-9]+', 0) as block_id from ({lines_sql('iso')}) l""")
def extract_entity_generic(spark, sf):
    raw = F.col("raw")
    return lines(spark, sf, "iso").select(
        "line_id", X.entity_generic(raw, _REQ).alias("request_id"), X.entity_generic(raw, "blk_[0-9]+").alias("block_id")
    )


@query("drop_unparsed", f"""
  select src, count(*) as total_lines, count(*) filter (where regexp_matches(raw, '{HDFS}')) as parsed,
    count(*) filter (where not regexp_matches(raw, '{HDFS}')) as parse_errors from ({_SHAPED}) s group by src""")
def drop_unparsed(spark, sf):
    df = shaped_lines(spark, sf)
    parts = [P.parse_errors(df.where(F.col("src") == i), FM.HDFS).withColumn("src", F.lit(i)) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FMT = [("hdfs", HDFS), ("openssh", _SSH), ("syslog", _SYS)]


def _detect_sql(shape: str) -> str:
    rates = " union all ".join(
        f"select {i} as seq, '{n}' as name, avg(case when regexp_matches(raw, '{p}') then 1.0 else 0.0 end) as share from head"
        for i, (n, p) in enumerate(_FMT)
    )
    return f"""select * from (with head as (select raw from ({lines_sql(shape)}) l order by line_id limit 20), r as ({rates})
      select '{shape}' as shape, name as format, cast(round(share, 6) as double) as share from r where share >= 0.8
      order by share desc, seq limit 1) x_{shape}"""


@query("detect_format", " union all ".join(_detect_sql(s) for s in ("hdfs", "openssh", "syslog", "iso")))
def detect_format(spark, sf):
    """The accepted format of four logs; the last one fits none."""
    out = None
    for s in ("hdfs", "openssh", "syslog", "iso"):
        row = FM.best_format(lines(spark, sf, s)).select(
            F.lit(s).alias("shape"), F.col("name").alias("format"), F.round("share", 6).alias("share")
        )
        out = row if out is None else out.unionByName(row)
    return out


def _entity_rates(shape: str) -> str:
    rates = " union all ".join(
        f"select {i} as seq, avg(case when regexp_matches(raw, '{p}') then 1.0 else 0.0 end) as share from head"
        for i, p in enumerate(X.ENTITY_SHAPES)
    )
    return f"""select * from (with head as (select raw from ({lines_sql(shape)}) l order by line_id limit 200), r as ({rates})
      select '{shape}' as shape, seq, cast(round(share, 6) as double) as share from r where share >= 0.3 and share > 0
      order by share desc, seq limit 1) y_{shape}"""


@query("detect_entity_pattern", " union all ".join(_entity_rates(s) for s in ("iso", "hdfs")))
def detect_entity_pattern(spark, sf):
    out = None
    for s in ("iso", "hdfs"):
        row = FM.best_entity(lines(spark, sf, s)).select(F.lit(s).alias("shape"), "seq", F.round("share", 6).alias("share"))
        out = row if out is None else out.unionByName(row)
    return out

@query("parsed_store", f"""
  select 'hdfs' as format, level, count(*) as events, count(distinct block_id) as blocks
  from ({with_('ev', 'select * from ev')}) e group by level
  union all
  select 'openssh', 'UNKNOWN', count(*), count(distinct regexp_extract(raw, 'sshd\\[(\\d+)\\]', 1))
  from ({lines_sql('openssh')}) l where regexp_matches(raw, '{_SSH}')
  union all
  select 'generic', case when lvl in {LEVELS} then lvl else 'UNKNOWN' end, count(*), count(distinct regexp_extract(raw, '{_REQ}', 1))
  from ({_generic_sql(f"select 0 as src, 0 as k, line_id, raw from ({lines_sql('iso')}) l", "*")}) g group by 2""")
def parsed_store(spark, sf):
    """A folder with logs of three kinds, parsed; then refreshed: nothing is left to parse."""
    src, store = fresh(spark, "logs"), fresh(spark, "store")
    for shape in ("hdfs", "openssh", "iso"):
        rows = lines(spark, sf, shape).repartitionByRange(4, "line_id").sortWithinPartitions("line_id")
        rows.select(F.col("raw").alias("value")).write.mode("append").text(src)
    stores.refresh_events(spark, src, store)
    ev = stores.refresh_events(spark, src, store)
    return ev.groupBy("format", "level").agg(F.count("*").alias("events"), F.count_distinct("block_id").alias("blocks"))


@query("auto_parse", f"""
  select 'hdfs' as shape, line_id, level, block_id from ({with_('ev', 'select * from ev')}) e
  union all
  select 'iso', line_id, case when lvl in {LEVELS} then lvl else 'UNKNOWN' end, regexp_extract(raw, '{_REQ}', 1)
  from ({_generic_sql(f"select 0 as src, 0 as k, line_id, raw from ({lines_sql('iso')}) l", "*")}) g""")
def auto_parse(spark, sf):
    """A log that fits a format and one that falls back to the generic parser."""
    parts = [
        P.parse_lines(lines(spark, sf, s), "auto").select(F.lit(s).alias("shape"), "line_id", "level", "block_id")
        for s in ("hdfs", "iso")
    ]
    return parts[0].unionByName(parts[1])


@query("tokenize", with_("ev", r"""
  select line_id, len(t) as n_tokens, array_to_string(t, '|') as tokens from (
    select line_id, string_split_regex(trim(content), '\s+') as t from ev) x"""))
def tokenize(spark, sf):
    t = X.tokens(F.col("content"))
    return events(spark, sf).select("line_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, "|").alias("tokens"))


@query("extract_params", with_("sev", r"""
  select line_id, array_to_string(list_transform(list_filter(list_zip(string_split_regex(trim(content), '\s+'),
    string_split(template, ' ')), lambda p: p[2] = '<*>' and p[1] is not null), lambda p: p[1]), '|') as params from sev"""))
def extract_params(spark, sf):
    ev = TP.with_params(tevents(spark, sf))
    return ev.select("line_id", F.array_join("params", "|").alias("params"))


@query("block_filter", with_("ev", """
  select e.block_id, e.line_id, e.level, b.blocks from ev e join
    (select min(block_id) as first_block, count(distinct block_id) as blocks from ev where block_id <> '') b
    on e.block_id = b.first_block"""))
def block_filter(spark, sf):
    """The distinct blocks, and the events of the first of them."""
    ev = events(spark, sf)
    ids = P.block_ids(ev).agg(F.min("block_id").alias("b"), F.count("*").alias("blocks")).first()
    return P.events_for_block(ev, ids["b"]).select(
        "block_id", "line_id", "level", F.lit(ids["blocks"]).cast("long").alias("blocks")
    )


@query("strip_log_prefix", f"""
  select line_id, case when len(f) >= 5 then regexp_replace(raw, '^(?:\\S+\\s+){{4}}', '') else raw end as content
  from (select line_id, raw, string_split_regex(raw, '\\s+') as f from ({CTE['lines']}) l) x
""")
def strip_log_prefix(spark, sf):
    from logweir.operators.template_quality import tuning_sample

    return tuning_sample(lines(spark, sf))
