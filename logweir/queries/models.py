"""Outlier models (E) and sweeps (G5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from logweir.operators import threshold as TH
from logweir.operators.elliptic import EllipticEnvelope
from logweir.operators.features import dense, feature_space, sparse_features, standardize
from logweir.operators.iforest import IForest
from logweir.operators.lof import Lof
from logweir.operators.svm import OneClassSvm
from logweir.operators.sweep import sweep
from logweir.plans import flows
from logweir.queries.base import lines, query, r6, tevents, with_
from logweir.queries.mined_sql import mined
from logweir.session import materialize, spread, work_dir
from logweir.sources import stores


def blocks(spark, sf):
    """Sparse and dense block vectors of the whole log."""
    ev = tevents(spark, sf)
    space = feature_space(ev)
    blk = sparse_features(ev, space).withColumn("features", dense(space.width))
    return materialize(blk, "blocks")


def scaled_blocks(spark, sf):
    blk = blocks(spark, sf)
    return materialize(spread(standardize(blk), blk.count(), 4_000), "scaled")


def _decided(scored, contamination=0.03):
    scored = materialize(scored.select("block_id", "score"), "scored")
    out = TH.flag_anomalies(scored, TH.contamination_offset(scored, contamination))
    return r6(out.select("block_id", "score", "anomaly_score", "is_anomaly"))


@query("iforest_fit")
def iforest_fit(spark, sf):
    model = IForest().fit(blocks(spark, sf))
    return model.nodes(spark).groupBy("tree").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("feature") < 0).alias("leaves"), F.round(F.max("path"), 6).alias("longest")
    )


@query("iforest_score")
def iforest_score(spark, sf):
    blk = blocks(spark, sf)
    return _decided(IForest().fit(blk).score(blk))


# a score that SQL can compute: minus a share of the event count and the span
_SCORED = """select block_id, -(count(*) % 7) / 10.0e0 - (max(line_id) - min(line_id)) / 100000.0e0 as score
  from ev where block_id <> '' group by block_id"""


def _scored(spark, sf):
    from logweir.operators.features import block_stats

    st = block_stats(tevents(spark, sf))
    return st.select("block_id", (-(F.col("event_count") % 7) / 10.0 - F.col("event_span") / 100000.0).alias("score"))


@query("contamination_threshold", with_("ev", """
  select round(quantile_cont(score, 0.03), 6) as p03, round(quantile_cont(score, 0.29), 6) as p29 from s""", s=_SCORED))
def contamination_threshold(spark, sf):
    scores = materialize(_scored(spark, sf), "scores")
    offs = [TH.contamination_offset(scores, c) for c in (0.03, 0.29)]
    return scores.agg(F.round(F.lit(offs[0]), 6).alias("p03"), F.round(F.lit(offs[1]), 6).alias("p29"))


_FLAGGED = "select block_id, score - (select quantile_cont(score, 0.03) from s) as anomaly_score, score < (select quantile_cont(score, 0.03) from s) as is_anomaly from s"


def _flagged(spark, sf):
    scores = materialize(_scored(spark, sf), "scores")
    return TH.flag_anomalies(scores, TH.contamination_offset(scores, 0.03))


@query("flag_anomalies", with_("ev", "select block_id, round(anomaly_score, 9) as anomaly_score, is_anomaly from f", s=_SCORED, f=_FLAGGED))
def flag_anomalies(spark, sf):
    out = _flagged(spark, sf)
    return out.select("block_id", F.round("anomaly_score", 9).alias("anomaly_score"), "is_anomaly")


@query("run_stats", with_("ev", """
  select count(*) filter (where is_anomaly) as anomaly_count, round(count(*) filter (where is_anomaly) / count(*), 4) as anomaly_rate,
    round(avg(anomaly_score), 4) as mean_anomaly_score, round(min(anomaly_score), 4) as min_anomaly_score,
    count(*) as total_blocks, (select count(distinct template) from (
      select regexp_replace(content, '\\S*[0-9]\\S*', '<*>', 'g') as template from ev) t) as vocab_size from f""", s=_SCORED, f=_FLAGGED))
def run_stats(spark, sf):
    return TH.run_stats(_flagged(spark, sf), feature_space(tevents(spark, sf)).size)


@query("lof")
def lof(spark, sf):
    return _decided(Lof(20).score(scaled_blocks(spark, sf)))


@query("ocsvm")
def ocsvm(spark, sf):
    return _decided(OneClassSvm(0.05).score(scaled_blocks(spark, sf)), 0.05)


@query("elliptic_envelope")
def elliptic_envelope(spark, sf):
    return _decided(EllipticEnvelope().score(scaled_blocks(spark, sf)))


@query("sgd_ocsvm")
def sgd_ocsvm(spark, sf):
    return _decided(OneClassSvm(0.05, 100, gamma="width").score(scaled_blocks(spark, sf)), 0.05)


def _stored_model(spark, sf, half: bool = False):
    """Train on the log, or on its first half, and store the model."""
    log = lines(spark, sf)
    known = log.where(F.col("line_id") <= log.agg(F.max("line_id")).first()[0] // 2) if half else log
    ev, tpl = flows.templated_events(known, "hdfs")
    model, space, _ = flows.detect(ev)
    path = f"{work_dir(spark)}/model-{uuid.uuid4().hex}"
    stores.save_model(model, space, tpl, path, "forest", "first-half" if half else "whole")
    return path, log


@query("infer")
def infer(spark, sf):
    """The whole log decided by a model of its first half (train and apply)."""
    path, log = _stored_model(spark, sf, half=True)
    model, space, seed = stores.load_model(spark, path)
    ev, _ = flows.templated_events(log, "hdfs", seed)
    return r6(flows.infer(ev, model, space).select("block_id", "score", "anomaly_score", "is_anomaly"))


@query("model_store", with_("sev", "select 'forest' as model_name, 'whole' as run_id, 'full' as feature_set, count(*) as vocab_size, 'Forest' as model_type from mt",
                            **mined("sev", "mt")).replace("with ", "with recursive ", 1))
def model_store(spark, sf):
    path, _ = _stored_model(spark, sf)
    return stores.model_info(spark, path)


@query("detect")
def detect(spark, sf):
    ev = tevents(spark, sf)
    _, _, out = flows.detect(ev)
    return r6(out.select("block_id", "is_anomaly", "anomaly_score", "event_count")).orderBy("block_id")


@query("model_sweep")
def model_sweep(spark, sf):
    """All default families and grids against FATAL blocks as labels."""
    ev = tevents(spark, sf)
    labels = ev.where("block_id <> ''").groupBy("block_id").agg(
        (F.count_if(F.col("level") == "FATAL") > 0).alias("is_anomaly")
    )
    return r6(sweep(ev, labels))
