"""Count-based tumbling windows of lines: statistics, detection, totals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions import text as X
from logweir.operators.dbscan import small_clusters
from logweir.operators.features import feature_space, sparse_features
from logweir.operators.ids import dense_by_order, running_sum
from logweir.operators.iforest import SUBSAMPLE, grow_trees, mean_path, path_lengths
from logweir.session import fan_out

WINDOW = 50
BLOCK = r"(blk_-?\d+)"


def count_windows(df: DataFrame, n: int = WINDOW, line: str = "line_id") -> DataFrame:
    """Adds window_index, 0 for lines 1..n."""
    return df.withColumn("window_index", F.floor((F.col(line) - 1) / n).cast("long"))


def window_sizes(df: DataFrame, n: int = WINDOW, keys: tuple[str, ...] = ()) -> DataFrame:
    return count_windows(df, n).groupBy(*keys, "window_index").agg(
        F.count("*").alias("lines_processed"), F.min("line_id").alias("first_line"), F.max("line_id").alias("last_line")
    )


def window_stats(lines: DataFrame, ev: DataFrame, n: int = WINDOW, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lines read, events parsed, blocks and error lines per window."""
    k = [*keys, "window_index"]
    read = count_windows(lines, n).groupBy(*k).agg(F.count("*").alias("lines_processed"))
    got = count_windows(ev, n).groupBy(*k).agg(
        F.count("*").alias("events_parsed"),
        F.count_distinct(F.nullif(F.col("block_id"), F.lit(""))).alias("blocks"),
        F.count_if(F.col("level").isin("ERROR", "FATAL")).alias("error_lines"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("events_parsed", "blocks", "error_lines")]
    return read.join(got, k, "left").select(*k, "lines_processed", *zero)


def window_min_blocks(ev: DataFrame, n: int = WINDOW, keys: tuple[str, ...] = (), least: int = 2) -> DataFrame:
    """Windows with enough distinct blocks to run a detection."""
    w = count_windows(ev, n).where("block_id <> ''").groupBy(*keys, "window_index")
    return w.agg(F.count_distinct("block_id").alias("blocks")).where(F.col("blocks") >= least)


def window_scores(x: np.ndarray, n_trees: int, seed: int) -> np.ndarray:
    """Forest score of each row of one window.  Up to SUBSAMPLE rows every tree sees all of them, so equal rows, of
    which a window is full, go down the trees once with their number."""
    n = len(x)
    psi = min(SUBSAMPLE, n)
    depth = int(math.ceil(math.log2(max(psi, 2))))
    rng = np.random.default_rng(seed)
    norm = float(mean_path([psi])[0]) or 1.0
    if psi == n:
        once, back, copies = np.unique(x, axis=0, return_inverse=True, return_counts=True)
        trees = grow_trees(np.repeat(once[None], n_trees, 0), depth, rng, copies)
        return -np.power(2.0, -path_lengths(once, *trees) / norm)[back.ravel()]
    sample = np.stack([x[rng.choice(n, psi, replace=False)] for _ in range(n_trees)])
    return -np.power(2.0, -path_lengths(x, *grow_trees(sample, depth, rng)) / norm)


def detect_one_window(
    pdf: pd.DataFrame, contamination: float, n_trees: int, eps: float, min_samples: int, seed: int
) -> pd.DataFrame:
    """Forest, threshold and clusters over the few blocks of one window."""
    pdf = pdf.sort_values("block_id", ignore_index=True)
    n = len(pdf)
    sizes = pdf["idx"].map(len).to_numpy()
    flat = np.concatenate([np.asarray(i, np.int64) for i in pdf["idx"]])
    cols, at = np.unique(flat, return_inverse=True)
    x = np.zeros((n, len(cols)))
    x[np.repeat(np.arange(n), sizes), at] = np.concatenate(pdf["val"].to_list())
    score = window_scores(x, n_trees, seed)
    decision = score - np.percentile(score, 100.0 * contamination)
    hot = np.flatnonzero(decision < 0)
    incident = np.full(n, -1)
    if len(hot):
        z = x[hot]
        sd = z.std(0)
        z = (z - z.mean(0)) / np.where(sd > 0, sd, 1.0)
        pts = pd.DataFrame({"pid": hot, "vec": list(z), "mult": 1})
        root = dict(zip(*small_clusters(pts, eps, min_samples)[["pid", "root"]].T.to_numpy()))
        order = sorted({(h in root, root.get(h, h)) for h in hot})
        incident[hot] = [order.index((h in root, root.get(h, h))) for h in hot]
    return pdf.assign(anomaly_score=decision, is_anomaly=decision < 0, incident_id=incident).drop(columns=["idx", "val"])


def window_detect(
    ev: DataFrame, n: int = WINDOW, contamination: float = 0.03, n_trees: int = 200, eps: float = 0.5,
    min_samples: int = 2, seed: int = 42, keys: tuple[str, ...] = (),
) -> DataFrame:
    """(keys, window_index, block_id, event_count, anomaly_score, is_anomaly,
    incident_id): every window is detected on its own; windows with fewer than
    two blocks give no rows, incident_id is -1 for normal blocks.

    Features are built for all windows at once.  Windows then pass through their
    tasks one after another, at most ``n`` lines each.
    """
    k = [*keys, "window_index"]
    win = count_windows(ev, n)
    ready = window_min_blocks(ev, n, keys).select(*k)
    blk = sparse_features(win, feature_space(win), tuple(k)).drop("template_ids").join(ready, k, "left_semi")
    schema = blk.drop("idx", "val").schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # the window that may go on in the next batch
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            starts = np.flatnonzero((pdf[k] != pdf[k].shift()).any(axis=1).to_numpy())
            done = [detect_one_window(pdf.iloc[a:b], contamination, n_trees, eps, min_samples, seed) for a, b in zip(starts, starts[1:])]
            held = pdf.iloc[starts[-1] :]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held is not None:
            yield detect_one_window(held, contamination, n_trees, eps, min_samples, seed)

    return fan_out(blk, *k).sortWithinPartitions(*k).mapInPandas(run, ddl + ", anomaly_score double, is_anomaly boolean, incident_id long")


def window_results(
    lines: DataFrame, ev: DataFrame, found: DataFrame, n: int = WINDOW, keys: tuple[str, ...] = ()
) -> DataFrame:
    """One row per window: statistics plus anomaly and incident counts."""
    k = [*keys, "window_index"]
    hits = found.where("is_anomaly").groupBy(*k).agg(
        F.count("*").alias("anomaly_count"), F.count_distinct("incident_id").alias("incident_count")
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("anomaly_count", "incident_count")]
    stats = window_stats(lines, ev, n, keys)
    return stats.join(hits, k, "left").select(*stats.columns, *zero)


def running_totals(windows: DataFrame, first_seen: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative events and anomalies, and templates seen so far.

    ``windows`` has window_index, events_parsed, anomaly_count; ``first_seen``
    has the window_index in which each template first appeared.
    """
    k = [*keys, "window_index"]
    new = first_seen.groupBy(*k).agg(F.count("*").alias("new_templates"))
    rows = windows.select(*k, "events_parsed", "anomaly_count").join(new, k, "left").withColumn(
        "new_templates", F.coalesce("new_templates", F.lit(0))
    )
    sums = {"total_events": "events_parsed", "total_anomalies": "anomaly_count", "templates_seen": "new_templates"}
    return running_sum(rows, "window_index", sums, keys).select(*k, *sums)


def first_windows(ev: DataFrame, n: int = WINDOW, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, template_id, window_index): where each template first appeared."""
    seen = ev.where("template_id >= 0").groupBy(*keys, "template_id").agg(F.min("line_id").alias("line_id"))
    return count_windows(seen, n).select(*keys, "template_id", "window_index")


def shuffled_blocks(df: DataFrame, n_lines: int = 100, seed: int = 0) -> DataFrame:
    """(pos, block_id, line_id, raw): whole blocks in a seeded random order, line
    order kept inside a block, until ``n_lines`` are reached (the last block may
    overshoot).  Lines without a block id are left out."""
    rows = df.withColumn("block_id", F.regexp_extract("raw", BLOCK, 1)).where("block_id <> ''")
    sizes = rows.groupBy("block_id").agg(F.count("*").alias("n"))
    keyed = sizes.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("block_id"))))
    # every block has a line, so n_lines blocks are always enough
    chosen = dense_by_order(keyed.orderBy("_h", "block_id").limit(n_lines), ["_h", "block_id"], "_i")
    upto = running_sum(chosen, "_i", {"_end": "n"}).where(F.col("_end") - F.col("n") < n_lines)
    picked = rows.join(upto.select("block_id", "_i"), "block_id")
    return dense_by_order(picked.select("_i", "block_id", "line_id", "raw"), ["_i", "line_id"], "pos").drop("_i")
