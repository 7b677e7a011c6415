"""Density clustering of standardised vectors (DBSCAN) as Spark jobs.

Neighbourhoods come from pivot cells; a task returns star edges of its local
eps-graph (one per point), and the components are merged across tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.operators.components import connected_components
from logweir.operators.neighbors import (
    CHUNK,
    Cells,
    build_cells,
    close_pairs,
    compare,
    distinct_points,
    epsilon_counts,
    matrix,
    sized,
    within,
)
from logweir.session import materialize


def local_roots(ok: np.ndarray) -> np.ndarray:
    """Smallest index of each point's component in a symmetric boolean graph."""
    root = np.full(len(ok), -1)
    for s in range(len(ok)):
        if root[s] >= 0:
            continue
        root[s] = s
        front = np.array([s])
        while len(front):
            new = np.flatnonzero(ok[front].any(0) & (root < 0))
            root[new] = s
            front = new
    return root


def star_links(edges: pd.DataFrame) -> pd.DataFrame:
    """Edges (u, v) that connect the same nodes: each to the smallest of its component."""
    n = len(edges)
    ends, ids = pd.factorize(np.concatenate([edges["u"].to_numpy(), edges["v"].to_numpy()]), sort=True)
    u, v = ends[:n], ends[n:]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    tied = root != np.arange(len(ids))
    return pd.DataFrame({"u": ids[tied], "v": ids[root[tied]]})


def _star_edges(cells: Cells, eps: float) -> DataFrame:
    pid = cells.points.schema["pid"].dataType.simpleString()

    def kernel(b: pd.DataFrame, bx: np.ndarray, q: pd.DataFrame, qx: np.ndarray) -> pd.DataFrame:
        qp, bp, links = q["pid"].to_numpy(), b["pid"].to_numpy(), [no_links]
        for i, j in close_pairs(qx, bx, eps):
            links.append(star_links(pd.DataFrame({"u": qp[i], "v": bp[j]})))
        return star_links(pd.concat(links)) if len(links) > 2 else links[-1]

    no_links = pd.DataFrame({"u": pd.Series(dtype=object), "v": pd.Series(dtype=object)})
    queries = cells.points.drop("sub").withColumn("reach", F.lit(float(eps)))
    found = compare(cells, queries, "reach", kernel, f"u {pid}, v {pid}", inner=eps / 2, merge=star_links)
    # points within eps/2 of one pivot all reach each other: one star, no pairs
    inside = cells.points.where(F.col("dist") <= eps / 2)
    hub = inside.groupBy("cell").agg(F.min("pid").alias("v"))
    stars = inside.join(hub, "cell").where("pid <> v").select(F.col("pid").alias("u"), "v")
    return found.unionByName(stars)


def _border_roots(cells: Cells, border: DataFrame, roots: DataFrame, eps: float) -> DataFrame:
    """Smallest component root within reach of each non-core point."""
    pid = cells.points.schema["pid"].dataType.simpleString()
    points = cells.points.drop("sub").join(roots.select(F.col("node").alias("pid"), "root"), "pid")
    rooted = sized(materialize(points, "rooted"), cells.pivots, cells.n)

    def kernel(b: pd.DataFrame, bx: np.ndarray, q: pd.DataFrame, qx: np.ndarray) -> pd.DataFrame:
        order = np.argsort(b["root"].to_numpy(), kind="stable")
        root, first = b["root"].to_numpy()[order], np.full(len(q), len(b))
        for i, j in close_pairs(qx, bx[order], eps):
            np.minimum.at(first, i, j)
        hit = first < len(b)
        return pd.DataFrame({"pid": q["pid"][hit], "root": root[first[hit]]})

    def smallest(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.groupby("pid", as_index=False, sort=False)["root"].min()

    queries = border.withColumn("reach", F.lit(float(eps))).withColumn("root", F.lit(None).cast(pid))
    found = compare(rooted, queries, "reach", kernel, f"pid {pid}, root {pid}", ("root",), merge=smallest)
    return found.groupBy("pid").agg(F.min("root").alias("root"))


def small_clusters(pdf: pd.DataFrame, eps: float, min_samples: int) -> pd.DataFrame:
    """(pid, root) of at most CHUNK distinct points."""
    pts = pdf.sort_values("pid", ignore_index=True)
    x, ids = matrix(pts["vec"]), pts["pid"].to_numpy()
    ok = within(x, x, eps)
    core = ok @ pts["mult"].to_numpy() >= min_samples
    at = np.flatnonzero(core)
    root = np.full(len(ids), -1)
    root[at] = at[local_roots(ok[np.ix_(at, at)])]
    reach = np.where(ok & core[None, :], root[None, :], len(ids)).min(1, initial=len(ids))
    root = np.where(core, root, np.where(reach < len(ids), reach, -1))
    kept = root >= 0
    return pd.DataFrame({"pid": ids[kept], "root": ids[root[kept]]})


def _cluster_small(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """One chunk holds all points: no cells, no merging across tasks."""
    pid = points.schema["pid"].dataType.simpleString()
    return points.groupBy().applyInPandas(
        lambda pdf: small_clusters(pdf, eps, min_samples), f"pid {pid}, root {pid}"
    )


def cluster_points(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(pid, root) of the distinct points (a stored table) that are not noise."""
    n = points.count()
    if n <= CHUNK:
        return _cluster_small(points, eps, min_samples)
    cells = build_cells(points, n)
    if min_samples <= 1:
        core = cells.points.select("pid")
    elif min_samples == 2:
        core = None  # whoever has a neighbour or a copy: read off the edges
    else:
        core = materialize(epsilon_counts(cells, eps).where(F.col("n") >= min_samples).select("pid"), "core")
    graph = cells
    if core is not None:
        graph = sized(materialize(cells.points.drop("sub").join(core, "pid", "left_semi"), "corepts"), cells.pivots, n)
    linked = connected_components(_star_edges(graph, eps))
    alone = graph.points if core is not None else graph.points.where("mult >= 2")
    alone = alone.select("pid").join(linked.select(F.col("node").alias("pid")), "pid", "left_anti")
    roots = linked.unionByName(alone.select(F.col("pid").alias("node"), F.col("pid").alias("root")))
    if core is None or min_samples <= 1:
        return roots.select(F.col("node").alias("pid"), "root")
    roots = materialize(roots, "roots")
    border = cells.points.drop("sub").join(core, "pid", "left_anti")
    return roots.select(F.col("node").alias("pid"), "root").unionByName(_border_roots(graph, border, roots, eps))


def dbscan(
    df: DataFrame, eps: float = 0.5, min_samples: int = 2, key: str = "block_id", vec: str = "features"
) -> DataFrame:
    """Adds ``cluster``: the smallest key of the row's cluster, null for noise.

    ``number_clusters`` turns it into 0-based labels in key order.
    """
    pts = materialize(distinct_points(df, key, vec), "distinct")
    roots = cluster_points(pts, eps, min_samples).withColumnRenamed("root", "cluster")
    found = pts.select("pid", F.col("vec").alias("_v")).join(roots, "pid", "left").drop("pid")
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    return df.withColumn("_v", v).join(found, "_v").drop("_v")


def number_clusters(clustered: DataFrame) -> DataFrame:
    """Adds ``label``: clusters by their smallest key from 0, noise -1."""
    from logweir.operators.ids import dense_by_order

    ids = dense_by_order(clustered.where("cluster is not null").select("cluster").distinct(), ["cluster"], "label", 0)
    return clustered.join(ids, "cluster", "left").withColumn("label", F.coalesce("label", F.lit(-1)).cast("long"))
