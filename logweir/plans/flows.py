"""End-to-end runs: detect, infer, summarise, analyse."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.operators import evaluate as E
from logweir.operators import summaries as S
from logweir.operators.features import FeatureSpace, feature_space, sparse_features
from logweir.operators.iforest import Forest, IForest
from logweir.operators.incidents import cluster
from logweir.operators.metrics import detect_totals
from logweir.operators.formats import file_formats, registered
from logweir.operators.parse import ParsePlan, parse_files, parse_with, plan_parse
from logweir.operators.templates import assign_templates, mine_templates, with_params, with_signature
from logweir.session import materialize, work_dir


@dataclass
class Detection:
    """All tables of one detection run."""

    lines: DataFrame
    events: DataFrame
    templates: DataFrame
    space: FeatureSpace
    model: Forest
    blocks: DataFrame  # block_id, idx, val, score, anomaly_score, is_anomaly, ...
    members: DataFrame  # incident_id, block_id, anomaly_score
    incident_lines: DataFrame
    incidents: DataFrame

    def totals(self) -> DataFrame:
        return detect_totals(self.lines, self.events, self.blocks, self.incidents)


def templated_events(
    lines: DataFrame, log_format: str = "auto", seed: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(events, templates): parsed, mined and matched; events are stored once
    and every later step reads only the columns it needs.  ``params`` follows
    from content and template, so it is computed when asked for.

    With ``auto``, lines of several files (with ``path``, numbered per file as
    ``file_line``) are parsed in each file's own format, and each format's lines
    are mined with its own settings on top of the templates so far."""
    if log_format == "auto" and {"path", "file_line"} <= set(lines.columns):
        heads = lines.select("path", F.col("file_line").alias("line_id"), "raw")
        parsed = materialize(with_signature(parse_files(lines, materialize(file_formats(heads), "formats"))), "parsed")
        found = {r["format"] for r in parsed.select("format").distinct().collect()}  # registered names
        templates = seed
        for fmt in [f for f in registered() if f.name in found] + [None] * ("generic" in found):
            plan = ParsePlan(fmt, None)
            mine = mine_templates(parsed.where(F.col("format") == (fmt.name if fmt else "generic")), plan.sim_th, plan.depth, templates)
            templates = materialize(mine, "templates")
        if templates is None:
            templates = materialize(mine_templates(parsed), "templates")
    else:
        plan = plan_parse(lines, log_format)
        parsed = materialize(with_signature(parse_with(lines, plan)), "parsed")
        templates = materialize(mine_templates(parsed, plan.sim_th, plan.depth, seed), "templates")
    events = materialize(assign_templates(parsed, templates), "events")
    return with_params(events), templates


def block_features(events: DataFrame, space: FeatureSpace) -> DataFrame:
    """Sparse vectors; ``dense(space.width)`` turns them into whole arrays."""
    return materialize(sparse_features(events, space), "blocks")


def detect(
    events: DataFrame, contamination: float = 0.03, n_trees: int = 200, feature_set: str = "full", seed: int = 42
) -> tuple[Forest, FeatureSpace, DataFrame]:
    """Fit on the blocks of the events and decide each of them."""
    space = feature_space(events, feature_set)
    blk = block_features(events, space)
    model, decided = IForest(n_trees, contamination, seed).fit_decide(blk)
    return model, space, decided


def infer(events: DataFrame, model: Forest, space: FeatureSpace) -> DataFrame:
    """Decide blocks with a stored model: features on its vocabulary, no fit.

    Templates the vocabulary does not know contribute nothing to its columns.
    A model without an offset gives its plain score as the decision value.
    """
    blk = model.score(block_features(events, space))
    from logweir.operators.threshold import flag_anomalies

    return materialize(flag_anomalies(blk, model.offset if model.offset is not None else 0.0), "decided")


def run_detect(
    lines: DataFrame, log_format: str = "auto", contamination: float = 0.03, n_trees: int = 200,
    eps: float = 0.5, min_samples: int = 2, feature_set: str = "full",
    stored: tuple[Forest, FeatureSpace, DataFrame] | None = None,
) -> Detection:
    """Lines (line_id, raw) to incidents; ``stored`` is a loaded model with its
    vocabulary and templates, used instead of fitting one."""
    events, templates = templated_events(lines, log_format, stored[2] if stored else None)
    if stored:
        model, space, _ = stored
        blocks = infer(events, model, space)
    else:
        model, space, blocks = detect(events, contamination, n_trees, feature_set)
    members, inc_lines, incidents = cluster(blocks, events, eps, min_samples)
    return Detection(lines, events, templates, space, model, blocks, members, inc_lines, materialize(incidents, "incidents"))


@dataclass
class Summaries:
    """All tables of one summary run; the judge tables only when asked for."""

    calls: DataFrame
    summaries: DataFrame
    rejected: DataFrame
    judge_calls: DataFrame | None = None
    gradings: DataFrame | None = None
    evaluation: DataFrame | None = None

    def usage(self) -> DataFrame:
        return S.usage_totals(self.calls, *([self.judge_calls] if self.judge_calls is not None else []))


def run_summarize(
    incidents: DataFrame, responder: Callable, judge: Callable | None = None, **call_options
) -> Summaries:
    """Prompt, answer and check every incident; ``judge`` grades the summaries.

    Calls are stored before they are parsed, and each answer is kept in a ledger at
    once, so no prompt is paid for twice; a ``ledger`` folder among the options
    makes that hold over several runs.
    """
    call_options.setdefault("ledger", f"{work_dir(incidents.sparkSession)}/calls-{uuid.uuid4().hex}")
    calls = materialize(S.answer_prompts(S.summary_prompts(incidents), responder, **call_options), "calls")
    good, bad = S.parse_summaries(calls)
    out = Summaries(calls, S.summarized(incidents, good, calls), bad)
    if judge is not None:
        graded = S.answer_prompts(S.judge_prompts(incidents, good), judge, **{**call_options, "model": f"{call_options.get('model', '')}/judge"})
        out.judge_calls = materialize(graded, "judge_calls")
        out.gradings = S.parse_quality(out.judge_calls)[0]
        usage = calls.drop("answer").unionByName(out.judge_calls.drop("answer"))
        out.evaluation = E.answer_eval(out.gradings, usage)
    return out


def run_analyze(
    lines: DataFrame, responder: Callable, judge: Callable | None = None, call_options: dict | None = None, **detect_options
) -> tuple[Detection, Summaries | None]:
    """Detect, then summarise; no calls are made when there are no incidents."""
    found = run_detect(lines, **detect_options)
    if found.incidents.isEmpty():
        return found, None
    return found, run_summarize(found.incidents, responder, judge, **(call_options or {}))


def scan_and_detect(spark: SparkSession, path: str, **options) -> Detection:
    from logweir.sources.lines import scan_log

    return run_detect(scan_log(spark, path, "both"), **options)
