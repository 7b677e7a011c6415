import json

import pytest
from pyspark.sql import functions as F

from logweir.operators import evaluate as E
from logweir.operators import incidents as I
from logweir.operators import metrics as M
from logweir.operators import summaries as S
from logweir.plans import flows

EV = "line_id long, block_id string, timestamp string, content string, template string"


def blocks(spark, rows):
    return spark.createDataFrame(rows, "block_id string, is_anomaly boolean, anomaly_score double, features array<double>")


def events(spark):
    return spark.createDataFrame([(i, f"b{i % 3}", f"0{i}", f"line {i}", "line <*>") for i in range(1, 10)], EV)


def test_no_anomalies_no_incidents(spark):
    assert I.cluster(blocks(spark, [("b0", False, 0.1, [1.0])]), events(spark))[2].count() == 0
    assert I.cluster(blocks(spark, []), events(spark))[2].count() == 0


def test_single_anomaly(spark):
    _, lines, inc = I.cluster(blocks(spark, [("b1", True, -0.3, [1.0]), ("b2", False, 0.2, [2.0])]), events(spark))
    r = inc.first()
    assert (r.incident_id, r["size"], r.severity, r.block_ids, r.line_count) == (0, 1, 0.3, ["b1"], 3)
    assert [(x.line_no, x.line_id) for x in lines.orderBy("line_no").collect()] == [(1, 1), (2, 4), (3, 7)]
    assert (r.time_range.start, r.time_range.end, r.templates) == ("01", "07", ["line <*>"])


def test_blocks_are_conserved(spark):
    rows = [("b0", True, -0.1, [1.0, 1.0, 0.0]), ("b1", True, -0.2, [1.1, 1.0, 0.0]), ("b2", True, -0.3, [1.0, 0.9, 0.0])]
    members, _, inc = I.cluster(blocks(spark, rows), events(spark), eps=1.0)
    assert sum(r["size"] for r in inc.collect()) == 3 and members.select("block_id").distinct().count() == 3


def test_noise_comes_first(spark):
    df = spark.createDataFrame([("c", None), ("a", "a"), ("z", None), ("b", "a")], "block_id string, cluster string")
    got = {r.block_id: r.incident_id for r in I.number_incidents(I.noise_as_singletons(df)).collect()}
    assert got == {"c": 0, "z": 1, "a": 2, "b": 2}


def test_severity_is_clamped(spark):
    df = spark.createDataFrame([(0, -1.7), (1, 0.4), (2, -0.25)], "incident_id int, anomaly_score double")
    assert {r.incident_id: (r.severity, r.band) for r in I.severity_band(I.incident_rows(df)).collect()} == {
        0: (1.0, "red"), 1: (0.0, "green"), 2: (0.25, "yellow")}


def test_digest(spark):
    members = spark.createDataFrame([(0, f"b{i}", -0.1) for i in range(5)], "incident_id long, block_id string, anomaly_score double")
    ev = spark.createDataFrame([(i, "b0", "", f"line {i}", "t") for i in range(9)], EV)
    r = I.digest(members, I.incident_lines(members, ev)).first()
    assert r.blocks == "b0, b1, b2 (+2 more)" and r["head"].split("\n") == [f"line {i}" for i in range(5)]


# -- summaries ----------------------------------------------------------------------

GOOD = {
    "incident_id": 7, "explanation": "e", "severity": "high", "severity_reasoning": "s",
    "remediation": [{"action": "a", "priority": "p"}], "root_cause": "r", "confidence": 0.5, "confidence_reasoning": "c",
}


def answers(spark, *docs):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "incident_id long, answer string")


def test_summary_checks(spark):
    bad = [
        {**GOOD, "severity": "catastrophic"}, {**GOOD, "confidence": 1.5}, {**GOOD, "confidence": -0.1},
        {k: v for k, v in GOOD.items() if k != "root_cause"}, "no json", {**GOOD, "remediation": [{"action": "a"}]},
    ]
    good, rejected = S.parse_summaries(answers(spark, GOOD, "```json\n" + json.dumps(GOOD) + "\n```", *bad))
    rows = good.orderBy("incident_id").collect()
    assert [r.incident_id for r in rows] == [0, 1] and rows[0].remediation[0].action == "a"
    assert {r.incident_id: r.reason for r in rejected.collect()} == {
        2: "bad severity", 3: "bad confidence", 4: "bad confidence", 5: "missing field", 6: "missing field", 7: "bad remediation"}


def test_quality_checks(spark):
    q = {"relevance": 5, "specificity": 4, "actionability": 4, "reasoning": "x"}
    good, bad = S.parse_quality(answers(spark, q, {**q, "relevance": 0}, {**q, "actionability": 6}, {**q, "reasoning": None}))
    assert good.first().mean_score == pytest.approx(13 / 3) and bad.count() == 3


def test_cost_and_evaluation_goldens(spark):
    u = spark.createDataFrame([(1_000_000, 100_000)], "input_tokens long, output_tokens long")
    assert S.usage_cost(u).first().estimated_cost_usd == 4.5
    q = spark.createDataFrame([(5, 4, 3), (3, 2, 5)], "relevance int, specificity int, actionability int")
    calls = spark.createDataFrame(
        [(800, 350, 100.0, 0.01), (600, 200, 0.0, 0.02), (0, 0, 300.0, 0.005), (0, 0, 0.0, 0.005)],
        "input_tokens long, output_tokens long, latency_ms double, estimated_cost_usd double")
    r = E.answer_eval(q, calls).first()
    assert (r.mean_relevance, r.mean_specificity, r.mean_actionability) == (4.0, 3.0, 4.0)
    assert (r.total_input_tokens, r.total_output_tokens, r.mean_latency_ms) == (1400, 550, 200.0)
    assert r.total_cost_usd == pytest.approx(0.04)
    none = E.answer_eval(q.where("false"), calls.where("false")).first()
    assert tuple(none) == (0.0, 0.0, 0.0, 0.0, 0, 0, 0.0, 0.0)


def preview(spark, n=100):
    members = spark.createDataFrame([(0, "b0", -0.25)], "incident_id long, block_id string, anomaly_score double")
    ev = spark.createDataFrame([(i, "b0", f"{i:03d}", f"line-{i}-", "line-<*>-") for i in range(n)], EV)
    return I.enrich(members, I.incident_lines(members, ev))


def test_prompt_shows_the_first_fifty_lines(spark):
    p = S.summary_prompts(preview(spark)).first().prompt
    assert "line-49-" in p and "line-50-" not in p and "(100 in all)" in p and "-0.2500" in p and "  - line-<*>-" in p
    empty = S.summary_prompts(preview(spark, 0)).first().prompt
    assert "(no log lines)" in empty and "(no templates)" in empty


def test_judge_prompt_shows_thirty(spark):
    good, _ = S.parse_summaries(answers(spark, GOOD))
    p = S.judge_prompts(preview(spark), good).first().prompt
    assert "line-29-" in p and "line-30-" not in p and "- [p] a" in p


def test_retries_double_the_delay(monkeypatch):
    waits, calls = [], []
    monkeypatch.setattr(S.time, "sleep", waits.append)

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert S.call_with_retry(flaky, "p", 3, 1.0) == "ok" and waits == [1.0, 2.0]
    calls.clear()
    with pytest.raises(TimeoutError):
        S.call_with_retry(flaky, "p", 2, 1.0)


def test_summary_run(spark):
    out = flows.run_summarize(
        preview(spark), lambda p: json.dumps(GOOD),
        lambda p: (json.dumps({"relevance": 5, "specificity": 4, "actionability": 3, "reasoning": "r"}), 10, 2))
    row = out.summaries.first()
    assert row.summary.severity == "high" and row.input_tokens > 0
    assert out.evaluation.first().mean_quality == 4.0 and out.usage().first().total_output_tokens > 2


# -- request metrics ------------------------------------------------------------------

def test_request_metrics(spark):
    df = spark.createDataFrame([("m", "a", 1, 0.004), ("m", "a", 2, 0.3), ("m", "a", 3, 99.0)], "name string, path string, ts long, value double")
    h = {r.le: r.cumulative for r in M.histogram(df, ["path"]).collect()}
    assert h["0.005"] == 1 and h["0.25"] == 1 and h["0.5"] == 2 and h["10.0"] == 2 and h["Inf"] == 3 and len(h) == 12
    assert M.counters(df, ["path"]).first().total == pytest.approx(99.304)
    assert M.gauges(df, ["path"]).first().value == 99.0


def test_large_incident_keeps_all_blocks_and_templates(spark):
    members = spark.createDataFrame([(0, f"blk_{i:04d}", -0.3) for i in range(500)], "incident_id long, block_id string, anomaly_score double")
    rows = [(0, f"blk_{i:04d}", i + 1, i + 1, f"line {i}", f"template {i:04d} <*>", "t") for i in range(500)]
    lines = spark.createDataFrame(rows, "incident_id long, block_id string, line_no long, line_id long, content string, template string, timestamp string")
    r = I.enrich(members, lines).first()
    assert len(r.block_ids) == len(r.templates) == r.template_count == 500 and len(r.log_lines) == I.PREVIEW_LINES
    assert r.block_ids == sorted(r.block_ids) and r.templates == sorted(r.templates)


def test_documents_hold_every_line(spark, tmp_path):
    """Incidents of 5,000, 3 and no lines, with text that JSON has to escape."""
    from logweir.sources.lines import scan_incidents
    from logweir.sources.stores import write_incident_documents

    members = spark.createDataFrame([(i, f"b{i}", -0.25) for i in range(4)] + [(0, "a0", -0.5)], "incident_id long, block_id string, anomaly_score double")
    text = {0: [f'line "{i}" \\ \u00e9 \t{{}}' for i in range(5_000)], 1: ["one", "two", "two"], 3: ["]}]}"]}
    rows = [(i, f"b{i}", f"{n:04d}", x, f"t{n % 3}") for i, lines in text.items() for n, x in enumerate(lines)]
    ev = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], EV)
    lines = I.incident_lines(members, ev)
    write_incident_documents(str(tmp_path / "docs"), I.enrich(members, lines), members, lines)
    got = {r.incident_id: r for r in scan_incidents(spark, str(tmp_path / "docs")).collect()}
    assert {i: r.log_lines for i, r in got.items()} == {0: text[0], 1: text[1], 2: [], 3: text[3]}
    assert got[0].block_ids == ["a0", "b0"] and got[0].templates == ["t0", "t1", "t2"] and got[0].time_range.end == "4999"
    assert got[2].block_ids == ["b2"] and got[2].severity == 0.25
    write_incident_documents(str(tmp_path / "none"), I.enrich(members.limit(0), lines.limit(0)), members.limit(0), lines.limit(0))
    assert scan_incidents(spark, str(tmp_path / "none")).count() == 0


def prompts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "incident_id long, prompt string")


def test_answers_are_paid_for_once(spark, tmp_path):
    """A repeated prompt and a repeated run find their answers; a failed prompt gives a row and is asked again."""
    paid = tmp_path / "paid"
    paid.mkdir()

    def model(prompt):
        if "bad" in prompt and not (paid / "fixed").exists():
            raise ValueError("no luck")
        (paid / f"{abs(hash(prompt))}-{len(list(paid.iterdir()))}").write_text(prompt)
        return f"answer to {prompt}", 10, 2

    def run(**options):
        rows = S.answer_prompts(prompts(spark, "one", "two words", "one", "bad one"), model, 2, 0.0, 3, **options).collect()
        return {r.incident_id: (r.answer, r.input_tokens, r.error) for r in rows}

    book = str(tmp_path / "ledger")
    first = run(ledger=book)
    assert first[0] == first[2] == ("answer to one", 10, None) and first[3] == (None, 0, "ValueError: no luck")
    assert len(list(paid.iterdir())) == 2
    (paid / "fixed").write_text("")
    again = run(ledger=book)
    assert again[3] == ("answer to bad one", 10, None) and {i: again[i] for i in (0, 1, 2)} == {i: first[i] for i in (0, 1, 2)}
    assert len(list(paid.iterdir())) == 4
    run(ledger=book, model="other")
    assert len(list(paid.iterdir())) == 7
    assert not list((tmp_path / "ledger").rglob("*.json.*"))


def test_a_retried_task_finds_its_answers(spark, tmp_path):
    """The task dies after its first answer; what it was paid for is there when it is run again."""
    book = S.Ledger(str(tmp_path / "ledger"))
    book.keep("one", ["kept", 1, 1, 5.0, None])

    def model(prompt):
        assert prompt != "one"
        return "new"

    rows = S.answer_prompts(prompts(spark, "one", "two"), model, 1, 0.0, 1, ledger=str(tmp_path / "ledger")).collect()
    assert {r.incident_id: r.answer for r in rows} == {0: "kept", 1: "new"}


def test_failed_calls_are_rejected_summaries(spark):
    def model(prompt):
        raise TimeoutError("slow")

    out = flows.run_summarize(preview(spark), model, model, retries=1)
    assert out.rejected.first().reason == "no answer" and out.summaries.first().summary is None
    assert out.calls.first().error == "TimeoutError: slow" and out.usage().first().total_cost_usd == 0
