"""Incident summaries by a text model: prompts, answers, checks and costs.

The model itself is a plug-in: any callable from prompt text to answer text.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions import text as X
from logweir.operators.incidents import PREVIEW_LINES
from logweir.session import arrow_files

# Prompt sizes, answer limits and prices per million tokens
JUDGE_LINES = 30
SEVERITIES = ("low", "medium", "high", "critical")
SCORE_RANGE = (1, 5)
PRICE_IN, PRICE_OUT = 3.0, 15.0
RETRIES, FIRST_DELAY = 3, 1.0

SUMMARY_SCHEMA = (
    "incident_id long, explanation string, severity string, severity_reasoning string, "
    "remediation array<struct<action:string,priority:string>>, root_cause string, "
    "confidence double, confidence_reasoning string"
)
SUMMARY_TEXTS = ("explanation", "severity_reasoning", "root_cause", "confidence_reasoning")
QUALITY_SCHEMA = "relevance int, specificity int, actionability int, reasoning string"
SCORES = ("relevance", "specificity", "actionability")

SUMMARY_INSTRUCTIONS = (
    "You help an operations team understand unusual log activity. Read the incident below and answer with "
    "one JSON object and nothing else. Keys: incident_id (integer), explanation (text), severity (low, medium, "
    "high or critical), severity_reasoning (text), remediation (list of objects with action and priority), "
    "root_cause (text), confidence (number from 0 to 1), confidence_reasoning (text)."
)
JUDGE_INSTRUCTIONS = (
    "You grade an incident analysis against the log lines it is based on. Answer with one JSON object and nothing "
    "else. Keys: relevance, specificity, actionability (integers from 1 to 5, 5 is best), reasoning (text)."
)


def summary_prompts(inc: DataFrame) -> DataFrame:
    """(incident_id, prompt): facts, the first 50 lines and all templates of an
    incident as produced by ``enrich``."""
    lines = F.array_join(F.transform(F.slice("log_lines", 1, PREVIEW_LINES), lambda x: F.concat(F.lit("  "), x)), "\n")
    tpl = F.array_join(F.transform("templates", lambda x: F.concat(F.lit("  - "), x)), "\n")
    text = F.concat(
        F.lit(SUMMARY_INSTRUCTIONS + "\n\n"),
        F.format_string("Incident %d\n", F.col("incident_id")),
        F.format_string("From %s to %s\n", F.col("time_range.start"), F.col("time_range.end")),
        F.lit("Blocks: "), F.array_join("block_ids", ", "), F.lit("\n"),
        F.format_string("Mean score: %.4f\n", F.col("mean_anomaly_score")),
        F.format_string("Severity: %.4f\n", F.col("severity")),
        F.format_string("Log lines (%d in all):\n", F.col("line_count")),
        F.when(lines == "", F.lit("  (no log lines)")).otherwise(lines),
        F.lit("\nTemplates:\n"),
        F.when(tpl == "", F.lit("  (no templates)")).otherwise(tpl),
    )
    return inc.select("incident_id", text.alias("prompt"))


def judge_prompts(inc: DataFrame, summaries: DataFrame) -> DataFrame:
    """(incident_id, prompt) asking to grade each parsed summary."""
    s = summaries.select("incident_id", "explanation", F.col("severity").alias("level"), "root_cause", "remediation")
    steps = F.array_join(
        F.transform("remediation", lambda r: F.concat(F.lit("- ["), r["priority"], F.lit("] "), r["action"])), "\n"
    )
    text = F.concat(
        F.lit(JUDGE_INSTRUCTIONS + "\n\nLog lines:\n"),
        F.array_join(F.slice("log_lines", 1, JUDGE_LINES), "\n"),
        F.lit("\n\nAnalysis:\nExplanation: "), "explanation",
        F.lit("\nSeverity: "), "level",
        F.lit("\nRoot cause: "), "root_cause",
        F.lit("\nRemediation:\n"), steps,
    )
    return inc.select("incident_id", "log_lines").join(s, "incident_id").select("incident_id", text.alias("prompt"))


def usage_cost(df: DataFrame) -> DataFrame:
    """Adds estimated_cost_usd from the token counts."""
    cost = F.col("input_tokens") / 1e6 * PRICE_IN + F.col("output_tokens") / 1e6 * PRICE_OUT
    return df.withColumn("estimated_cost_usd", F.round(cost, 6))


def call_with_retry(responder: Callable, prompt: str, retries: int, delay: float):
    for attempt in range(retries):
        try:
            return responder(prompt)
        except Exception:  # whatever the plug-in raises counts as a failed call
            if attempt + 1 == retries:
                raise
            time.sleep(delay * 2**attempt)


class Ledger:
    """Answers that were paid for: one small file a call, under the hash of model and
    prompt, in a folder that all executors share.  A file is there whole or not at all."""

    def __init__(self, folder: str, model: str = ""):
        self.folder, self.model = folder, model
        self.files, self.root = arrow_files(folder)

    def _path(self, prompt: str) -> str:
        key = hashlib.sha256(f"{len(self.model)}:{self.model}{prompt}".encode()).hexdigest()
        return f"{self.root}/{key[:2]}/{key}.json"

    def find(self, prompt: str) -> list | None:
        from pyarrow import fs

        path = self._path(prompt)
        if self.files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self.files.open_input_stream(path) as f:
            return json.loads(f.read())

    def keep(self, prompt: str, call: list) -> None:
        path = self._path(prompt)
        aside = f"{path}.{uuid.uuid4().hex}"
        self.files.create_dir(path.rsplit("/", 1)[0])
        with self.files.open_output_stream(aside) as f:
            f.write(json.dumps(call).encode())
        self.files.move(aside, path)


CALLS = "incident_id long, answer string, input_tokens long, output_tokens long, latency_ms double, error string"


def answer_prompts(
    prompts: DataFrame, responder: Callable[[str], str | tuple[str, int, int]],
    retries: int = RETRIES, delay: float = FIRST_DELAY, tasks: int | None = None, ledger: str | None = None, model: str = "",
) -> DataFrame:
    """(incident_id, answer, input_tokens, output_tokens, latency_ms, error,
    estimated_cost_usd): one call per prompt, spread over ``tasks`` tasks.

    The responder returns the answer text, or (text, input, output tokens);
    without counts, whitespace words are counted.  A prompt whose calls all fail
    gives a row with ``error`` and no answer.

    Every answer is kept in the ``ledger`` folder as soon as it is there and looked
    up before a call, so a task or run that is repeated, and a prompt that stands
    twice, pays for none again.  Failed calls are not kept.  ``model`` tells ledgers
    of different responders apart.
    """

    def call(prompt: str, book: Ledger | None) -> list:
        got = book.find(prompt) if book else None
        if got is None:
            t0 = time.monotonic()
            try:
                said = call_with_retry(responder, prompt, retries, delay)
            except Exception as problem:  # one row per failure, the other answers stay
                return [None, 0, 0, round((time.monotonic() - t0) * 1000, 1), f"{type(problem).__name__}: {problem}"]
            ms = round((time.monotonic() - t0) * 1000, 1)
            got = [*(said if isinstance(said, tuple) else (said, len(prompt.split()), len(said.split()))), ms, None]
            if book:
                book.keep(prompt, got)
        return got

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = Ledger(ledger, model) if ledger else None
        for pdf in batches:
            out = [(i, *call(prompt, book)) for i, prompt in zip(pdf["incident_id"], pdf["prompt"])]
            yield pd.DataFrame(out, columns=["incident_id", "answer", "input_tokens", "output_tokens", "latency_ms", "error"])

    n = tasks or prompts.sparkSession.sparkContext.defaultParallelism
    # equal prompts meet in one task, so that the second finds the answer to the first
    rows = prompts.select(F.col("incident_id").cast("long"), F.coalesce("prompt", F.lit("")).alias("prompt"))
    rows = rows.repartition(n, "prompt" if ledger else "incident_id")
    return usage_cost(rows.mapInPandas(run, CALLS))


def _checked(df: DataFrame, schema: str, problem) -> tuple[DataFrame, DataFrame]:
    parsed = df.withColumn("_s", F.from_json(X.strip_fence(F.col("answer")), schema)).withColumn("reason", problem)
    good = parsed.where("reason is null")
    bad = parsed.where("reason is not null").select("incident_id", "answer", "reason")
    return good, bad


def parse_summaries(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) summaries of (incident_id, answer).

    The incident id of the row overrides the one in the answer.
    """
    s = F.col("_s")
    missing = F.lit(False)
    for name in (*SUMMARY_TEXTS, "severity", "confidence", "remediation"):
        missing = missing | s[name].isNull()
    steps = F.exists(s["remediation"], lambda r: r.isNull() | r["action"].isNull() | r["priority"].isNull())
    problem = (
        F.when(F.col("answer").isNull(), "no answer")
        .when(s.isNull() | missing, "missing field")
        .when(steps, "bad remediation")
        .when(~s["severity"].isin(*SEVERITIES), "bad severity")
        .when(~s["confidence"].between(0.0, 1.0), "bad confidence")
    )
    good, bad = _checked(df, SUMMARY_SCHEMA, problem)
    return good.select("incident_id", *[s[c].alias(c) for c in (
        "explanation", "severity", "severity_reasoning", "remediation", "root_cause", "confidence",
        "confidence_reasoning")]), bad


def parse_quality(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) gradings; good ones carry mean_score."""
    s = F.col("_s")
    lo, hi = SCORE_RANGE
    missing, outside = s["reasoning"].isNull(), F.lit(False)
    for name in SCORES:
        missing = missing | s[name].isNull()
        outside = outside | ~s[name].between(lo, hi)
    problem = F.when(F.col("answer").isNull(), "no answer").when(s.isNull() | missing, "missing field").when(outside, "score out of range")
    good, bad = _checked(df, QUALITY_SCHEMA, problem)
    mean = (s["relevance"] + s["specificity"] + s["actionability"]) / 3.0
    return good.select("incident_id", *[s[c].alias(c) for c in (*SCORES, "reasoning")], mean.alias("mean_score")), bad


def usage_totals(*calls: DataFrame) -> DataFrame:
    """Token and cost totals over all call tables."""
    cols = ["input_tokens", "output_tokens", "estimated_cost_usd"]
    rows = calls[0].select(*cols)
    for c in calls[1:]:
        rows = rows.unionByName(c.select(*cols))
    return rows.agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("total_output_tokens"),
        F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
    )


def summarized(inc: DataFrame, parsed: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """Incidents with their summary and the usage of the call (0 by default)."""
    out = inc.select("incident_id", "block_ids", F.col("severity").alias("severity_score")).join(
        parsed.select("incident_id", F.struct(*[c for c in parsed.columns if c != "incident_id"]).alias("summary")),
        "incident_id", "left",
    )
    names = ("input_tokens", "output_tokens", "latency_ms", "estimated_cost_usd")
    if usage is not None:
        out = out.join(usage.select("incident_id", *names), "incident_id", "left")
    zero = {n: F.coalesce(F.col(n), F.lit(0)) if usage is not None else F.lit(0) for n in names}
    return out.select(
        "incident_id", "block_ids", "severity_score", "summary",
        zero["input_tokens"].cast("long").alias("input_tokens"),
        zero["output_tokens"].cast("long").alias("output_tokens"),
        zero["latency_ms"].cast("double").alias("latency_ms"),
        zero["estimated_cost_usd"].cast("double").alias("estimated_cost_usd"),
    )
