"""Evaluation (G), summaries by a text model (H), metrics (J)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from logweir.functions import text as X
from logweir.operators import evaluate as E
from logweir.operators import metrics as M
from logweir.operators import summaries as S
from logweir.plans import flows
from logweir.queries.base import ORACLES, lines, query, r6, table, tevents, with_
from logweir.queries.incidents import _INC, _LINES, _members, detection
from logweir.queries.models import _FLAGGED, _SCORED, _flagged
from logweir.session import materialize, work_dir
from logweir.sources import stores

# -- labels: documents judged as toxic, predicted by their size -----------------


def _judged(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("block_id"), (F.col("n_chars") % 10 == 3).alias("is_anomaly")
    )
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("block_id"), (F.col("toxic") == 1).alias("is_anomaly"))
    return docs, lab


_J = """select d.doc_id as block_id, n_chars % 10 = 3 as predicted, toxic = 1 as actual from documents d join labels l using (doc_id)"""
_C = f"""select count(*) filter (where predicted and actual) as true_positives, count(*) filter (where predicted and not actual) as false_positives,
  count(*) filter (where not predicted and actual) as false_negatives, count(*) filter (where not predicted and not actual) as true_negatives,
  count(*) as total_blocks from ({_J}) j"""
_P = f"""select *, case when precision + recall > 0 then round(2 * precision * recall / (precision + recall), 6) else 0.0 end as f1 from (
  select *, case when true_positives + false_positives > 0 then true_positives / (true_positives + false_positives) else 0.0 end as precision,
    case when true_positives + false_negatives > 0 then true_positives / (true_positives + false_negatives) else 0.0 end as recall from ({_C}) c) p"""


@query("join_labels", _J)
def join_labels(spark, sf):
    return E.join_labels(*_judged(spark, sf))


@query("confusion_counts", _C)
def confusion_counts(spark, sf):
    return E.confusion(E.join_labels(*_judged(spark, sf)))


@query("precision_recall_f1", f"select * replace (cast(round(precision, 6) as double) as precision, cast(round(recall, 6) as double) as recall, cast(f1 as double) as f1) from ({_P}) q")
def precision_recall_f1(spark, sf):
    return r6(E.evaluate(*_judged(spark, sf)))


_RUNS = """select event_type || '-' || user_id as run, min(event_id) as seq, round(avg(value) / 500, 9) as f1 from events group by event_type, user_id"""


@query("leaderboard", f"""
  select run, seq, f1, row_number() over (order by f1 desc, seq) = 1 as is_best from ({_RUNS}) r""")
def leaderboard(spark, sf):
    runs = table(spark, sf, "events").groupBy(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("run")).agg(
        F.min("event_id").alias("seq"), F.round(F.avg("value") / 500, 9).alias("f1")
    )
    return E.leaderboard(runs)


@query("compare_runs", """
  select substr(cast(o_orderkey as varchar), 1, 8) as run_id, o_orderstatus as status,
    case when o_orderpriority = '1-URGENT' then o_orderpriority else '-' end as urgent, '-' as vocab_size
  from orders order by o_orderdate desc, o_orderkey desc limit 5""")
def compare_runs(spark, sf):
    runs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("start_time"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority")).alias("urgent"),
    )
    return E.compare_runs(runs, ["status", "urgent", "vocab_size"])


@query("append_run", with_("sev", """
  select 'run-' || c as run_id, c as contamination, cast((select count(distinct template) from sev) as varchar) as vocab_size,
    cast((select count(*) from sev) as varchar) as input_rows
  from (values ('0.03'), ('0.05')) v(c)"""))
def append_run(spark, sf):
    """Two detection runs with different settings, logged and compared."""
    path = f"{work_dir(spark)}/runs-{uuid.uuid4().hex}"
    ev = tevents(spark, sf)
    from logweir.operators.threshold import run_stats

    for c in (0.03, 0.05):
        _, space, blk = flows.detect(ev, c, 100)
        m = run_stats(blk, space.size).first().asDict()
        stores.append_run(spark, path, "detection", {"contamination": c, "vocab_size": m.pop("vocab_size")}, m, f"run-{c}", ev)
    runs = stores.read_runs(spark, path, ["contamination", "vocab_size", "input_rows"], ["anomaly_rate", "mean_anomaly_score", "anomaly_count"])
    return E.compare_runs(runs, ["contamination", "vocab_size", "input_rows"])


# -- model answers rendered from the documents -----------------------------------

_SEV = "case doc_id % 5 when 0 then 'low' when 1 then 'medium' when 2 then 'high' when 3 then 'critical' else 'catastrophic' end"
_CONF = "case doc_id % 7 when 0 then '1.5' when 1 then '-0.1' else '0.' || (doc_id % 10) end"


def _answer(s: str) -> str:
    return f"""concat(case when doc_id % 2 = 0 then concat('```json', chr(10)) else '' end,
      '{{"incident_id": 99, "explanation": "about ', lang, '", "severity": "', {_SEV}, '", "severity_reasoning": "', source,
      '", "remediation": [{{"action": "check ', cast(doc_id as {s}), '", "priority": "immediate"}}]',
      case when doc_id % 11 = 0 then '' else concat(', "root_cause": "disk ', cast(doc_id % 13 as {s}), '"') end,
      ', "confidence": ', {_CONF}, ', "confidence_reasoning": "r"}}', case when doc_id % 2 = 0 then concat(chr(10), '```') else '' end)"""


def _quality_answer(s: str) -> str:
    return f"""concat('{{"relevance": ', cast(1 + doc_id % 6 as {s}), ', "specificity": ', cast(doc_id % 5 + 1 as {s}),
      ', "actionability": ', cast(doc_id % 7 as {s}), case when doc_id % 9 = 0 then '' else ', "reasoning": "ok"' end, '}}')"""


def _answers(spark, sf, render) -> object:
    return table(spark, sf, "documents").selectExpr("doc_id as incident_id", f"{render('string')} as answer")


_FENCED = f"select doc_id as incident_id, {_answer('varchar')} as answer from documents"


@query("strip_code_fence", f"""
  select incident_id, trim(regexp_replace(regexp_replace(answer, '^```json\\n', ''), '\\n```$', '')) as clean from ({_FENCED}) a
  union all
  select -1 - doc_id, case when starts_with(trim(text, {"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"}), '```') then null
    else trim(text, {"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"}) end from documents""")
def strip_code_fence(spark, sf):
    ans = _answers(spark, sf, _answer)
    docs = table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("incident_id"), F.col("text").alias("answer"))
    return ans.unionByName(docs).select("incident_id", X.strip_fence(F.col("answer")).alias("clean"))


@query("parse_summaries", f"""
  select doc_id as incident_id, reason, case when reason is null then {_SEV} end as severity, case when reason is null then cast({_CONF} as double) end as confidence,
    case when reason is null then 'check ' || doc_id end as action, case when reason is null then 'disk ' || (doc_id % 13) end as root_cause
  from (select *, case when doc_id % 11 = 0 then 'missing field' when doc_id % 5 = 4 then 'bad severity' when doc_id % 7 < 2 then 'bad confidence' end as reason from documents) d""")
def parse_summaries(spark, sf):
    good, bad = S.parse_summaries(_answers(spark, sf, _answer))
    a = good.select(
        "incident_id", F.lit(None).cast("string").alias("reason"), "severity", "confidence",
        F.col("remediation")[0]["action"].alias("action"), "root_cause",
    )
    b = bad.select("incident_id", "reason", *[F.lit(None).cast(t).alias(n) for n, t in (
        ("severity", "string"), ("confidence", "double"), ("action", "string"), ("root_cause", "string"))])
    return a.unionByName(b)


_GOODQ = "doc_id % 9 <> 0 and 1 + doc_id % 6 <= 5 and doc_id % 7 between 1 and 5"


@query("parse_quality", f"""
  select doc_id as incident_id, 1 + doc_id % 6 as relevance, doc_id % 5 + 1 as specificity, doc_id % 7 as actionability,
    round(((1 + doc_id % 6) + (doc_id % 5 + 1) + doc_id % 7) / 3.0e0, 6) as mean_score from documents where {_GOODQ}""")
def parse_quality(spark, sf):
    good, _ = S.parse_quality(_answers(spark, sf, _quality_answer))
    return r6(good.select("incident_id", *[F.col(c).cast("long").alias(c) for c in S.SCORES], "mean_score"))


_USAGE = """select doc_id as incident_id, n_chars as input_tokens, n_chars // 4 as output_tokens,
  case when doc_id % 3 = 0 then 0.0e0 else cast(n_chars % 1000 as double) end as latency_ms from documents"""
_COST = "round(input_tokens / 1e6 * 3 + output_tokens / 1e6 * 15, 6)"


def _usage(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("incident_id"), F.col("n_chars").cast("long").alias("input_tokens"),
        F.floor(F.col("n_chars") / 4).cast("long").alias("output_tokens"),
        F.when(F.col("doc_id") % 3 == 0, 0.0).otherwise((F.col("n_chars") % 1000).cast("double")).alias("latency_ms"),
    )


@query("usage_cost", f"select incident_id, {_COST} as estimated_cost_usd from ({_USAGE}) u")
def usage_cost(spark, sf):
    return S.usage_cost(_usage(spark, sf)).select("incident_id", "estimated_cost_usd")


@query("usage_rollup", f"""
  select cast(sum(input_tokens) as bigint) as total_input_tokens, cast(sum(output_tokens) as bigint) as total_output_tokens,
    round(sum({_COST}), 6) as total_cost_usd from (select * from ({_USAGE}) a union all select * from ({_USAGE}) b where incident_id % 2 = 0) u""")
def usage_rollup(spark, sf):
    calls = S.usage_cost(_usage(spark, sf))
    return r6(S.usage_totals(calls, calls.where("incident_id % 2 = 0")))


@query("llm_eval_summary", f"""
  select round(avg(r), 6) as mean_relevance, round(avg(s), 6) as mean_specificity, round(avg(a), 6) as mean_actionability,
    round((avg(r) + avg(s) + avg(a)) / 3, 6) as mean_quality, any_value(ti) as total_input_tokens, any_value(t_o) as total_output_tokens,
    any_value(tc) as total_cost_usd, any_value(ml) as mean_latency_ms
  from (select 1 + doc_id % 6 as r, doc_id % 5 + 1 as s, doc_id % 7 as a from documents where {_GOODQ}) q,
    (select cast(sum(input_tokens) as bigint) as ti, cast(sum(output_tokens) as bigint) as t_o, round(sum({_COST}), 6) as tc,
      round(avg(case when latency_ms > 0 then latency_ms end), 6) as ml from ({_USAGE}) u) w""")
def llm_eval_summary(spark, sf):
    good, _ = S.parse_quality(_answers(spark, sf, _quality_answer))
    return r6(E.answer_eval(good, S.usage_cost(_usage(spark, sf))))


@query("summarized_join", f"""
  select r.incident_id, round(sev, 6) as severity_score, case when a.incident_id is null then null else a.root_cause end as root_cause,
    coalesce(u.input_tokens, 0) as input_tokens, coalesce(u.output_tokens, 0) as output_tokens
  from ({with_('ev', 'select incident_id, greatest(0.0, least(1.0, -avg(anomaly_score))) as sev from n group by incident_id', **_INC)}) r
  left join (select doc_id as incident_id, 'disk ' || (doc_id % 13) as root_cause from documents
    where doc_id % 11 <> 0 and doc_id % 5 <> 4 and doc_id % 7 >= 2) a using (incident_id)
  left join (select * from ({_USAGE}) x where incident_id % 2 = 0) u using (incident_id)""")
def summarized_join(spark, sf):
    from logweir.operators.incidents import all_of, incident_rows

    m = _members(spark, sf)
    inc = incident_rows(m).join(all_of(m, "block_id", "block_ids"), "incident_id")
    good, _ = S.parse_summaries(_answers(spark, sf, _answer))
    usage = S.usage_cost(_usage(spark, sf)).where("incident_id % 2 = 0")
    return r6(S.summarized(inc, good, usage).select(
        "incident_id", "severity_score", F.col("summary.root_cause").alias("root_cause"), "input_tokens", "output_tokens"
    ))


def _previews(spark, sf):
    from logweir.operators.incidents import enrich, incident_lines

    m = _members(spark, sf)
    return enrich(m, materialize(incident_lines(m, tevents(spark, sf)), "incident_lines"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_BLOCKS = "array_to_string(b, ', ')"


@query("build_prompts", with_("sev", f"""
  select incident_id, {_sql_text(S.SUMMARY_INSTRUCTIONS)} || chr(10) || chr(10) || 'Incident ' || incident_id || chr(10) ||
    'From ' || t0 || ' to ' || t1 || chr(10) || 'Blocks: ' || {_BLOCKS} || chr(10) ||
    'Mean score: ' || printf('%.4f', ms) || chr(10) || 'Severity: ' || printf('%.4f', greatest(0.0, least(1.0, -ms))) || chr(10) ||
    'Log lines (' || len(l) || ' in all):' || chr(10) || array_to_string(list_transform(l[1:50], lambda x: '  ' || x), chr(10)) || chr(10) ||
    'Templates:' || chr(10) || array_to_string(list_transform(t, lambda x: '  - ' || x), chr(10)) as prompt
  from (select incident_id, list(block_id order by block_id) as b, avg(anomaly_score) as ms from n group by incident_id) x
  join (select incident_id, list(content order by line_no) as l, list_sort(list(distinct template)) as t, min(timestamp) as t0, max(timestamp) as t1
    from il group by incident_id) y using (incident_id)""", **_INC, il=_LINES))
def build_prompts(spark, sf):
    return S.summary_prompts(_previews(spark, sf))


@query("build_judge_prompts", with_("sev", f"""
  select incident_id, {_sql_text(S.JUDGE_INSTRUCTIONS)} || chr(10) || chr(10) || 'Log lines:' || chr(10) || array_to_string(l[1:30], chr(10)) ||
    chr(10) || chr(10) || 'Analysis:' || chr(10) || 'Explanation: about ' || lang || chr(10) || 'Severity: ' || {_SEV} || chr(10) ||
    'Root cause: disk ' || (doc_id % 13) || chr(10) || 'Remediation:' || chr(10) || '- [immediate] check ' || doc_id as prompt
  from (select incident_id, list(content order by line_no) as l from il group by incident_id) x
  join (select * from documents where doc_id % 11 <> 0 and doc_id % 5 <> 4 and doc_id % 7 >= 2) d on d.doc_id = x.incident_id""", **_INC, il=_LINES))
def build_judge_prompts(spark, sf):
    good, _ = S.parse_summaries(_answers(spark, sf, _answer))
    return S.judge_prompts(_previews(spark, sf), good)


def stub_summary(prompt: str) -> str:
    """A deterministic stand-in for a text model."""
    n = len(prompt)
    return json.dumps({
        "incident_id": 0, "explanation": f"{n} characters", "severity": ("low", "medium", "high")[n % 3],
        "severity_reasoning": "length", "remediation": [{"action": "look", "priority": "immediate"}],
        "root_cause": "unknown", "confidence": (n % 10) / 10, "confidence_reasoning": "length",
    })


def stub_judge(prompt: str) -> str:
    n = len(prompt)
    return "```json\n" + json.dumps(
        {"relevance": 1 + n % 5, "specificity": 1 + n % 4, "actionability": 1 + n % 3, "reasoning": "length"}
    ) + "\n```"


def _stub(n: str) -> str:
    """The stand-in's answer to a prompt of n characters, as SQL."""
    return f"""'{{"incident_id": 0, "explanation": "' || {n} || ' characters", "severity": "' || case {n} % 3 when 0 then 'low' when 1 then 'medium' else 'high' end ||
      '", "severity_reasoning": "length", "remediation": [{{"action": "look", "priority": "immediate"}}], "root_cause": "unknown", "confidence": 0.' || ({n} % 10) ||
      ', "confidence_reasoning": "length"}}'"""


def _n_words(text: str) -> str:
    return f"len(list_filter(string_split_regex({text}, '\\s+'), lambda x: x <> ''))"


_TURNS = "select conv_id * 1000 + turn as incident_id, text as prompt from conversations"


@query("llm_map", f"""
  select *, {_COST} as estimated_cost_usd from (
    select incident_id, answer, {_n_words('prompt')} as input_tokens, {_n_words('answer')} as output_tokens, cast(null as varchar) as error
    from (select *, {_stub('length(prompt)')} as answer from ({_TURNS}) t) a) b""")
def llm_map(spark, sf):
    """Every conversation turn answered by the stand-in model."""
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("incident_id"), F.col("text").alias("prompt")
    )
    return S.answer_prompts(turns, stub_summary, ledger=f"{work_dir(spark)}/calls-{uuid.uuid4().hex}").drop("latency_ms")


_SUMMED = f"select incident_id, prompt, length(prompt) as n, {_stub('length(prompt)')} as answer from ({ORACLES['build_prompts']}) p"
_JUDGED = with_("sev", f"""
  select incident_id, {_sql_text(S.JUDGE_INSTRUCTIONS)} || chr(10) || chr(10) || 'Log lines:' || chr(10) || array_to_string(l[1:30], chr(10)) ||
    chr(10) || chr(10) || 'Analysis:' || chr(10) || 'Explanation: ' || n || ' characters' || chr(10) ||
    'Severity: ' || case n % 3 when 0 then 'low' when 1 then 'medium' else 'high' end || chr(10) || 'Root cause: unknown' || chr(10) ||
    'Remediation:' || chr(10) || '- [immediate] look' as prompt
  from (select incident_id, list(content order by line_no) as l from il group by incident_id) x join ({_SUMMED}) s using (incident_id)""", **_INC, il=_LINES)


@query("summarize_end_to_end", f"""
  select round(avg(r), 6) as mean_relevance, round(avg(s), 6) as mean_specificity, round(avg(a), 6) as mean_actionability, round((avg(r) + avg(s) + avg(a)) / 3, 6) as mean_quality,
    any_value(i) as total_input_tokens, any_value(o) as total_output_tokens, any_value(c) as total_cost_usd
  from (select 1 + length(prompt) % 5 as r, 1 + length(prompt) % 4 as s, 1 + length(prompt) % 3 as a from ({_JUDGED}) j) q,
    (select cast(sum(input_tokens) as bigint) as i, cast(sum(output_tokens) as bigint) as o, round(sum({_COST}), 6) as c from (
      select {_n_words('prompt')} as input_tokens, {_n_words('answer')} as output_tokens from ({_SUMMED}) p
      union all select {_n_words('prompt')}, {len(stub_judge('').split())} from ({_JUDGED}) k) u) w""")
def summarize_end_to_end(spark, sf):
    out = flows.run_summarize(_previews(spark, sf), stub_summary, stub_judge)
    return r6(out.evaluation.drop("mean_latency_ms"))


@query("analyze_end_to_end")
def analyze_end_to_end(spark, sf):
    _, out = flows.run_analyze(materialize(lines(spark, sf), "lines"), stub_summary, stub_judge)
    return out.summaries.select("incident_id", F.round("severity_score", 6).alias("severity_score"), F.col("summary.severity").alias("severity"))


@query("write_summaries", f"""
  select incident_id, case n % 3 when 0 then 'low' when 1 then 'medium' else 'high' end as severity, {_n_words('prompt')} as input_tokens from ({_SUMMED}) s""")
def write_summaries(spark, sf):
    path = f"{work_dir(spark)}/summaries-{uuid.uuid4().hex}"
    out = flows.run_summarize(_previews(spark, sf), stub_summary, stub_judge)
    stores.write_summaries(path, out.summaries, out.evaluation)
    return spark.read.json(f"{path}/summaries").select("incident_id", "summary.severity", "input_tokens")


# -- request metrics ---------------------------------------------------------------


def _requests(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "ts", F.concat(F.lit("requests_"), "event_type").alias("name"),
        (F.col("user_id") % 5).cast("string").alias("path"), (F.col("value") / 40).alias("value"),
    )


_REQ = "select event_id, ts, concat('requests_', event_type) as name, cast(user_id % 5 as varchar) as path, value / 40 as value from events"


@query("counter_rollup", f"select name, path, round(sum(value), 6) as total from ({_REQ}) r group by name, path")
def counter_rollup(spark, sf):
    return M.counters(_requests(spark, sf), ["path"]).withColumn("total", F.round("total", 6))


_BOUNDS = ", ".join(f"('{b}', {b}e0)" for b in M.BUCKETS) + ", ('Inf', 'infinity'::double)"


@query("latency_histogram", f"""
  select name, path, le, count(*) filter (where value <= b) as cumulative, round(sum(value), 6) as sum, count(*) as count
  from ({_REQ}) r, (values {_BOUNDS}) v(le, b) group by name, path, le""")
def latency_histogram(spark, sf):
    return M.histogram(_requests(spark, sf), ["path"]).withColumn("sum", F.round("sum", 6))


@query("last_gauge", f"select name, path, round(arg_max(value, event_id), 6) as value from ({_REQ}) r group by name, path")
def last_gauge(spark, sf):
    return r6(M.gauges(_requests(spark, sf), ["path"], tie="event_id"))
