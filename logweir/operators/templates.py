"""Message templates: stateless signatures, fixed-depth-tree mining, matching.

Mining follows the published fixed-depth parse tree (He et al., "Drain", ICWS
2017).  A strict replay is sequential, so here lines are first collapsed to
distinct digit-masked signatures (a map-side aggregate that removes nearly all
rows), and only the signatures of one tree leaf are merged together.

Inside a leaf the merge is a greedy choice of leaders: in the order of appearance
a signature joins the most similar leader before it, or becomes a leader if none
shares ``sim_th`` of its positions; the template of a leader is what all that
joined it have in common.  The result depends on that order alone, not on how the
work is cut.  A leaf of any size is settled in batches of its first open rows:
one task finds a batch's leaders, then all later rows meet just these, in chunks.
A row without a leader stays open, so every round settles its whole batch and all
rows that resemble one of its leaders.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions import text as X
from logweir.operators.ids import dense_by_number, dense_by_order
from logweir.session import discard, fan_out, free_shuffles, materialize

# Fixed values of the published tree
MAX_CHILDREN = 100
LEAF_CHUNK = 5_000  # signatures that meet in one task
PAIRS = 1 << 20  # candidate pairs held at a time

W = X.WILDCARD


# -- stateless signatures ------------------------------------------------------

def with_signature(ev: DataFrame) -> DataFrame:
    return ev if "signature" in ev.columns else ev.withColumn("signature", X.signature(F.col("content")))


def number_templates(ev: DataFrame, col: str = "signature") -> DataFrame:
    """(template_id, template, size, first_line): ids by first appearance."""
    agg = ev.groupBy(F.col(col).alias("template")).agg(
        F.count("*").alias("size"), F.min("line_id").alias("first_line")
    )
    return dense_by_number(agg, "first_line", "template_id", tie="template").select(
        "template_id", "template", "size", "first_line"
    )


def signature_events(ev: DataFrame) -> DataFrame:
    """Events with the stateless template and its id."""
    sig = with_signature(ev)
    ids = number_templates(sig).select("template_id", "template")
    return sig.withColumnRenamed("signature", "template").join(ids, "template")


def template_count(ev: DataFrame, col: str = "template") -> DataFrame:
    return ev.agg(F.count_distinct(col).alias("template_count"))


# -- distinct signatures with constant digits put back --------------------------

def distinct_signatures(ev: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, signature, tokens, size, first_line) per distinct signature.

    A digit position whose token never varies inside a signature gets its
    literal back: the tree only wildcards positions that differ.
    """
    k = list(keys)
    # lines are told apart by the MD5 of their signature: the text itself is sent once, for the signature's first line
    src = with_signature(ev).select(*k, F.unhex(F.md5("signature")).alias("_key"), "line_id", "content")
    # only fixed-width aggregates, so this stays a hash aggregate: a position is
    # constant when the smallest and the largest token hash agree
    marks = F.filter(
        F.transform(
            X.tokens(F.col("content")),
            lambda t, i: F.struct(i.alias("pos"), F.when(t.rlike("[0-9]"), F.xxhash64(t)).alias("h")),
        ),
        lambda s: s["h"].isNotNull(),
    )
    whole = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("h")))
    long = src.select(*k, "_key", "line_id", F.inline(F.concat(whole, marks)))
    per_pos = long.groupBy(*k, "_key", "pos").agg(
        F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("n"), F.min("line_id").alias("first"),
    )
    const = F.when((F.col("pos") >= 0) & (F.col("lo") == F.col("hi")), F.col("pos"))
    sig = per_pos.groupBy(*k, "_key").agg(
        F.max(F.when(F.col("pos") == -1, F.col("n"))).alias("size"),
        F.min("first").alias("first_line"),
        F.collect_list(const).alias("_const"),
    )
    on = [*k, "_key"]
    first = sig.select(*[F.col(c).alias(f"_of_{c}") for c in (*on, "first_line")], "first_line", "size", "_const")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on] + [F.col("line_id").eqNullSafe(F.col("_of_first_line"))]
    # lines may share a number: all of one signature agree where its literals are
    one = src.join(first, same).groupBy(*on, "line_id").agg(
        *[F.any_value(c).alias(c) for c in ("first_line", "size", "_const")], F.any_value("content").alias("_text")
    )
    tokens = F.transform(
        X.tokens(F.col("_text")),
        lambda t, i: F.when(t.rlike("[0-9]") & ~F.array_contains("_const", i), F.lit(W)).otherwise(t),
    )
    return one.select(*k, X.signature(F.col("_text")).alias("signature"), tokens.alias("tokens"), "size", "first_line")


# -- fixed-depth tree ----------------------------------------------------------

def _prefix_len(depth: int) -> int:
    return max(depth - 3, 0)


def _own_child(sig: DataFrame, keys: list[str], parent: list[str], tok: str) -> DataFrame:
    """Tokens that get their own child under a parent: the first 99 without a
    digit, by first appearance; all others share the wildcard child."""
    seen = (
        sig.where(~F.col(tok).rlike("[0-9]") & (F.col(tok) != W))
        .groupBy(*keys, *parent, tok).agg(F.min("first_line").alias("_f"))
    )
    rank = F.row_number().over(Window.partitionBy(*keys, *parent).orderBy("_f", tok))
    return seen.withColumn("_rk", rank).where(F.col("_rk") < MAX_CHILDREN).drop("_f", "_rk")


def leaf_keys(sig: DataFrame, depth: Column, max_depth: int, keys: list[str]) -> DataFrame:
    """Adds ``leaf``: token count plus the tree path of the first tokens."""
    out = sig.withColumn("_n", F.size("tokens"))
    parent = ["_n"]
    for level in range(_prefix_len(max_depth)):
        tok, child = f"_k{level}", f"_c{level}"
        # the last token of a line is never part of the path
        used = (F.lit(level) < depth - 3) & (F.col("_n") > level + 1)
        out = out.withColumn(tok, F.when(used, F.get("tokens", F.lit(level))))
        own = _own_child(out.where(F.col(tok).isNotNull()), keys, parent, tok)
        own = own.withColumn(child, F.col(tok))
        own = F.broadcast(own) if level == 0 else own  # at most 99 rows a token count
        on = [*keys, *parent, tok]
        out = out.join(own, on, "left").withColumn(
            child, F.when(F.col(tok).isNull(), F.lit("")).otherwise(F.coalesce(child, F.lit(W)))
        )
        parent = [*parent, child]
    leaf = F.to_json(F.struct(*parent))
    return out.withColumn("leaf", leaf).drop(*[c for c in out.columns if c.startswith(("_k", "_c", "_n"))])


def need(width: int, sim_th: float) -> int:
    """Least number of equal positions of similar rows; one literal at least."""
    return max(1, int(np.ceil(width * sim_th - 1e-9)))


def find_leaders(codes: np.ndarray, fixed: np.ndarray, least: int) -> np.ndarray:
    """Which rows become leaders, in row order; ``fixed`` rows always do.  Code 0
    is the wildcard, which equals nothing."""
    lead = np.zeros(len(codes), bool)
    heads = np.empty_like(codes)
    k = 0
    for i, row in enumerate(codes):
        if fixed[i] or not k or int(((heads[:k] == row) & (row != 0)).sum(axis=1).max()) < least:
            heads[k] = row
            lead[i] = True
            k += 1
    return lead


def closest(codes: np.ndarray, rank: np.ndarray, heads: np.ndarray, head_rank: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(equal positions, rank of the leader) of each row's most similar leader
    before it, the earliest of equals; 0 and -1 where none has ``least``.

    A Hamming join: leaders are listed by (position, token).  Rows that share
    ``least`` of m literals share one of any m - least + 1 of them, so a row is
    looked up by the positions where it meets fewest leaders only.
    """
    n, width = codes.shape
    score, owner = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    if not len(heads) or not n:
        return score, owner
    order = np.argsort(heads, axis=0, kind="stable")
    low, high = np.empty((n, width), np.int64), np.empty((n, width), np.int64)
    for p in range(width):
        lists = heads[order[:, p], p]
        low[:, p], high[:, p] = np.searchsorted(lists, codes[:, p]), np.searchsorted(lists, codes[:, p], "right")
    size = np.where(codes == 0, len(heads) + 1, high - low)
    by_size = np.argsort(size, axis=1, kind="stable")
    probes = (codes != 0).sum(axis=1) - least + 1  # none where too few literals are left
    used = np.arange(width) < probes[:, None]
    total = np.cumsum(np.where(used, np.take_along_axis(size, by_size, 1), 0).sum(axis=1))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        rows, cols = np.nonzero(used[at:end])
        pos = by_size[at:end][rows, cols]
        first, count = low[at:end][rows, pos], (high - low)[at:end][rows, pos]
        row = np.repeat(rows, count)
        head = order[np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), np.repeat(pos, count)]
        pair = np.unique(row * len(heads) + head)
        row, head = pair // len(heads) + at, pair % len(heads)
        keep = head_rank[head] < rank[row]
        row, head = row[keep], head[keep]
        same = ((codes[row] == heads[head]) & (codes[row] != 0)).sum(axis=1)
        keep = same >= least
        row, head, same = row[keep], head[keep], same[keep]
        best = np.lexsort((head_rank[head], -same, row))
        best = best[np.r_[True, np.diff(row[best]) > 0]] if len(best) else best
        score[row[best]], owner[row[best]] = same[best], head_rank[head[best]]
        at = end
    return score, owner


def _codes(*tables: pd.Series) -> list[np.ndarray]:
    """Token lists of one length as rows of numbers, 0 being the wildcard."""
    rows = [np.array(t.tolist(), dtype=object).reshape(len(t), -1) for t in tables]
    width = max(r.shape[1] for r in rows)
    flat, _ = pd.factorize(np.concatenate([[W], *[r.ravel() for r in rows]]))
    cuts = np.cumsum([r.size for r in rows])[:-1]
    return [c.reshape(-1, width) for c in np.split(flat[1:], cuts)]


def _settled(pdf: pd.DataFrame, leaf: list[str]) -> pd.DataFrame:
    """Whole leaves: one row for each leader (``owner``), with what its rows have in common."""
    pdf = pdf.assign(_new=pdf["seed_id"] < 0).sort_values(["_new", "seed_id", "first_line", "text"], na_position="first", ignore_index=True)
    owner, text = np.arange(len(pdf)), pdf["text"].to_numpy().copy()
    for at in pdf.groupby(leaf, sort=False, dropna=False).indices.values():
        if len(at) > 1:
            (codes,), rank = _codes(pdf["text"].iloc[at].str.split(" ")), owner[at]
            least = need(codes.shape[1], float(pdf["sim_th"].iloc[at[0]]))
            lead = find_leaders(codes, pdf["seed_id"].to_numpy()[at] >= 0, least)
            _, mine = closest(codes, rank, codes[lead], rank[lead], least)
            owner[at] = mine = np.where(lead, rank, mine)
            order = np.argsort(mine, kind="stable")  # a leader comes before all that joined it
            starts = np.flatnonzero(np.r_[True, np.diff(mine[order]) > 0])
            varies = np.minimum.reduceat(codes[order], starts) != np.maximum.reduceat(codes[order], starts)
            for g in np.flatnonzero(varies.any(axis=1)):
                row = at[order[starts[g]]]
                text[row] = " ".join(W if v else t for t, v in zip(text[row].split(" "), varies[g]))
    sums = pdf.assign(owner=owner).groupby("owner").agg({"size": "sum", "first_line": "min", "seed_id": "max"})
    return pdf.drop(columns=list(sums)).assign(owner=owner, text=text)[owner == np.arange(len(pdf))].merge(sums, on="owner")


def _ranked(sig: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with ``rank``, dense over all leaves: templates of earlier runs
    first, then by first line and text.  (``_settled`` orders whole leaves alike.)"""
    text = F.array_join("tokens", " ")
    return dense_by_order(sig, [F.col("seed_id") < 0, "seed_id", "first_line", text, *keys], "rank")


def _settle_large(rows: DataFrame, leaf: list[str], sizes: DataFrame) -> DataFrame:
    """``owner`` for the rows of leaves that no single task should hold."""
    cols = [*leaf, "sim_th", "tokens", "size", "first_line", "seed_id", "rank"]
    parts = F.ceil(F.col("rows") / LEAF_CHUNK).cast("int").alias("parts")
    cur = rows.join(sizes.select(*leaf, parts), leaf).select(
        *cols, "parts", F.pmod(F.xxhash64("rank"), F.col("parts")).cast("int").alias("chunk"),
        F.lit(0).cast("long").alias("same"), F.lit(-1).cast("long").alias("owner"))
    cur = materialize(cur, "open-rows")
    while True:
        # a batch of a leaf: its first open rows, by whole rank ranges of LEAF_CHUNK
        is_open = F.col("owner") < 0
        ranges = cur.where(is_open).groupBy(*leaf, F.floor(F.col("rank") / LEAF_CHUNK).alias("range")).agg(F.count("*").alias("n"))
        so_far = F.sum("n").over(Window.partitionBy(*leaf).orderBy("range"))
        first = F.row_number().over(Window.partitionBy(*leaf).orderBy("range"))
        ends = (
            ranges.withColumn("sum", so_far).withColumn("nth", first).where((F.col("sum") <= 2 * LEAF_CHUNK) | (F.col("nth") == 1))
            .groupBy(*leaf).agg(((F.max("range") + 1) * LEAF_CHUNK).alias("end"), (F.min("range") * LEAF_CHUNK).alias("start"))
        )
        ends = materialize(ends, "batches")
        if not ends.take(1):
            return cur.select(*cols, "owner")
        batch = cur.where(is_open).join(ends, leaf).where("rank < end")

        def lead(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("rank", ignore_index=True)
            (codes,) = _codes(pdf["tokens"])
            return pdf[find_leaders(codes, pdf["seed_id"].to_numpy() >= 0, need(codes.shape[1], float(pdf["sim_th"].iloc[0])))]

        shape = batch.select(*leaf, "sim_th", "tokens", "seed_id", "rank", "parts").schema
        heads = materialize(batch.select(shape.names).groupBy(*leaf).applyInPandas(lead, shape), "leaders")
        copies = heads.select(*leaf, "tokens", "rank", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"))
        later = cur.join(ends.select(*leaf, "start"), leaf, "left").where("start is not null and rank >= start").drop("start")
        done = cur.join(ends.select(*leaf, "start"), leaf, "left").where("start is null or rank < start").drop("start")

        def meet(key: tuple, pdf: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf) or not len(heads):
                return pdf
            codes, head_codes = _codes(pdf["tokens"], heads["tokens"])
            rank, head_rank = pdf["rank"].to_numpy(), heads["rank"].to_numpy()
            same, owner = closest(codes, rank, head_codes, head_rank, need(codes.shape[1], float(pdf["sim_th"].iloc[0])))
            before, mine = pdf["same"].to_numpy(), pdf["owner"].to_numpy()
            better = (same > before) & (mine != rank) & (pdf["seed_id"].to_numpy() < 0)  # earlier leaders win ties
            owner, same = np.where(better, owner, mine), np.where(better, same, before)
            leads = np.isin(rank, head_rank)
            return pdf.assign(owner=np.where(leads, rank, owner), same=same)

        by = [*leaf, "chunk"]
        met = later.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(meet, cur.schema)
        before, cur = cur, materialize(done.unionByName(met), "open-rows")
        discard(before)  # the rounds would leave a copy of the text each


def merge_signatures(sig: DataFrame, depth: Column, max_depth: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Templates (keys, tokens, template, size, first_line, seed_id) of a signature table
    with columns tokens, size, first_line, sim_th and seed_id (-1 = new)."""
    k, leaf = list(keys), [*keys, "leaf"]
    cols = [*leaf, "sim_th", "tokens", "size", "first_line", "seed_id"]
    sig = materialize(sig, "signatures", "zstd")
    free_shuffles(sig.sparkSession)
    rows = leaf_keys(sig, depth, max_depth, k).select(*cols)
    sizes = materialize(rows.groupBy(*leaf).agg(F.count("*").alias("rows")), "leaf-sizes")
    large = materialize(sizes.where(F.col("rows") > LEAF_CHUNK), "large-leaves")
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    cores = sig.sparkSession.sparkContext.defaultParallelism
    buckets = max(min(4 * cores, -(-total // 50)), -(-total // LEAF_CHUNK), 1)  # many small leaves share a task
    small = rows.join(large, leaf, "left_anti").withColumn("bucket", F.pmod(F.xxhash64(*leaf), F.lit(buckets)))
    names = [*k, "text", "size", "first_line", "seed_id"]
    # tokens hold no blank: as one text they take a fraction of the room
    small = small.withColumn("text", F.array_join("tokens", " ")).drop("tokens")
    shape = small.select(*names).schema
    settled = fan_out(small, "bucket", groups=buckets).groupBy("bucket").applyInPandas(lambda pdf: _settled(pdf, leaf)[names], shape)
    settled = materialize(settled, "settled", "zstd")
    if large.take(1):
        ranked = _ranked(rows.join(large.select(*leaf), leaf, "left_semi"), k)
        found = _settle_large(ranked, leaf, large)
        # what the rows of a leader have in common
        at = found.select("owner", F.posexplode("tokens").alias("pos", "t")).groupBy("owner", "pos").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        common = F.struct("pos", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(W).alias("t"))
        tokens = at.groupBy("owner").agg(F.transform(F.sort_array(F.collect_list(common)), lambda x: x["t"]).alias("tokens")).select("owner", F.array_join("tokens", " ").alias("text"))
        sums = found.groupBy(*k, "owner").agg(F.sum("size").alias("size"), F.min("first_line").alias("first_line"), F.max("seed_id").alias("seed_id"))
        settled = settled.unionByName(materialize(sums.join(tokens, "owner").select(*names), "settled-large", "zstd"))
    discard(sig)
    free_shuffles(sig.sparkSession)
    # different leaders may end at one text; stored templates stay apart, as their ids are known
    stored = F.collect_list(F.when(F.col("seed_id") >= 0, F.struct("seed_id", "size")))
    fresh = F.coalesce(F.sum(F.when(F.col("seed_id") < 0, F.col("size"))), F.lit(0)).cast("long")
    one = settled.groupBy(*k, "text").agg(fresh.alias("n"), F.min("first_line").alias("first_line"), F.sort_array(stored).alias("old"))
    first = F.get(F.col("old"), F.lit(0))["seed_id"]
    kept = F.transform("old", lambda s: F.struct(s["seed_id"].alias("seed_id"), (s["size"] + F.when(s["seed_id"] == first, F.col("n")).otherwise(0)).cast("long").alias("size")))
    new = F.array(F.struct(F.lit(-1).cast("long").alias("seed_id"), F.col("n").alias("size")))
    return one.select(*k, "text", "first_line", F.inline(F.when(F.size("old") > 0, kept).otherwise(new))).select(
        *k, F.split("text", " ").alias("tokens"), F.col("text").alias("template"), "size", "first_line", "seed_id")


def mine_templates(
    ev: DataFrame, sim_th: float = 0.4, depth: int = 4, seed: DataFrame | None = None
) -> DataFrame:
    """(template_id, tokens, template, size, first_line) of the events.

    ``seed`` holds templates of an earlier run: they keep their ids, take part
    in the merge before new lines, and new ids continue after the largest.
    """
    sig = distinct_signatures(ev).select("tokens", "size", "first_line").withColumn("seed_id", F.lit(-1).cast("long"))
    if seed is not None:
        old = seed.select(
            "tokens", F.col("size").cast("long").alias("size"),
            F.lit(-1).cast("long").alias("first_line"), F.col("template_id").alias("seed_id"),
        )
        sig = sig.unionByName(old)
    sig = sig.withColumn("sim_th", F.lit(float(sim_th)))
    found = materialize(merge_signatures(sig, F.lit(depth), depth).drop("tokens"), "mined", "zstd")
    free_shuffles(found.sparkSession)
    return _numbered(found.withColumn("tokens", F.split("template", " ")), seed)


def _numbered(found: DataFrame, seed: DataFrame | None) -> DataFrame:
    cols = ["template_id", "tokens", "template", "size", "first_line"]
    start = 1
    if seed is not None:
        start = int(seed.agg(F.coalesce(F.max("template_id"), F.lit(0)).alias("m")).first()["m"]) + 1
    new = dense_by_number(found.where("seed_id < 0").drop("tokens"), "first_line", "template_id", start, tie="template")
    out = new.withColumn("tokens", F.split("template", " ")).select(*cols)
    if seed is None:
        return out
    kept = found.where("seed_id >= 0").withColumn("template_id", F.col("seed_id"))
    # an old template keeps the line it was first seen on
    kept = kept.drop("first_line").join(seed.select("template_id", "first_line"), "template_id")
    return out.unionByName(kept.select(*cols))


# -- matching lines to templates -------------------------------------------------

LITERAL_DIGITS = 1_000


def _canonical(content: Column, digits: list[str]) -> Column:
    keep = F.array(*[F.lit(d) for d in digits]) if digits else F.array().cast("array<string>")
    return F.array_join(
        F.transform(
            X.tokens(content),
            lambda t: F.when(t.rlike("[0-9]") & ~F.array_contains(keep, t), F.lit(W)).otherwise(t),
        ),
        " ",
    )


def canonical_form(content: Column, templates: DataFrame) -> Column:
    """Text that decides which templates a line matches: digit tokens that no
    template spells out are masked, everything else is kept.  Without spelled-out
    digits that is the ``signature`` column."""
    digits = (
        templates.select(F.explode("tokens").alias("t")).where(F.col("t").rlike("[0-9]"))
        .distinct().limit(LITERAL_DIGITS + 1).collect()
    )
    if not digits:
        return F.col("signature")
    if len(digits) > LITERAL_DIGITS:  # too many to list: match on the whole text
        return F.array_join(X.tokens(content), " ")
    return _canonical(content, [r["t"] for r in digits])


def full_matches(forms: DataFrame, templates: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every full match: the rows of ``forms`` (with ``form``) next to the
    matching rows of ``templates`` (with tokens), plus ``literals``, the number
    of literal positions.  ``templates`` may come in separate sets (``keys``).

    Templates of one length and first token are grouped by which positions are
    literal.  A form is looked up once per such mask by its literal tokens - an
    equi-join, so lines and templates are never paired blindly.
    """
    k = list(keys)
    lit = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get("tokens", i) != W)
    tpl = (
        templates.withColumn("_n", F.size("tokens")).withColumn("_head", F.get("tokens", F.lit(0)))
        .withColumn("_mask", lit)
        .withColumn("_key", F.transform("_mask", lambda i: F.get("tokens", i)))
        .drop("tokens")
    )
    masks = tpl.select(*k, "_n", "_head", "_mask").distinct()
    probes = (
        forms.withColumn("_t", F.split("form", " ")).withColumn("_n", F.size("_t"))
        .withColumn("_head", F.explode(F.array_distinct(F.array(F.get("_t", F.lit(0)), F.lit(W)))))
        .join(masks, ["_n", "_head"])
        .withColumn("_key", F.transform("_mask", lambda i: F.get("_t", i)))
        .drop("_t")
    )
    on = [*k, "_n", "_head", "_mask", "_key"]
    return probes.join(tpl, on).withColumn("literals", F.size("_mask")).drop("_n", "_head", "_mask", "_key")


def match_forms(forms: DataFrame, templates: DataFrame) -> DataFrame:
    """(form, template_id, template): best full match of each distinct form.
    Most wildcards win, then the lowest id."""
    hits = full_matches(forms, templates.select("template_id", "template", "tokens"))
    best = F.min_by(F.struct("template_id", "template"), F.struct("literals", "template_id"))
    return hits.groupBy("form").agg(best.alias("_b")).select("form", "_b.template_id", "_b.template")


def assign_templates(ev: DataFrame, templates: DataFrame) -> DataFrame:
    """Events with template_id and template; unmatched lines get -1 and their
    own content."""
    with_form = with_signature(ev).withColumn("form", canonical_form(F.col("content"), templates))
    found = match_forms(with_form.select("form").distinct(), templates)
    return (
        with_form.join(found, "form", "left").drop("form", "signature")
        .withColumn("template", F.coalesce("template", "content"))
        .withColumn("template_id", F.coalesce("template_id", F.lit(-1)).cast("long"))
    )


def with_params(ev: DataFrame) -> DataFrame:
    return ev.withColumn("params", X.params(F.col("content"), F.col("template")))


# -- ground truth ------------------------------------------------------------------

def assign_catalog(df: DataFrame, catalog: DataFrame, col: str = "content") -> DataFrame:
    """Adds ``gt_id``: the first catalog regex found in the text, else -1.

    Distinct texts are tested once, by one flat expression for a catalog (a
    hand-written file) of any size.
    """
    rows = catalog.orderBy("idx").collect()
    texts = df.select(col).distinct()
    hits = [F.when(F.col(col).rlike(r["regex"]), F.lit(int(r["idx"]))) for r in rows]
    tested = texts.withColumn("gt_id", F.coalesce(*hits, F.lit(-1)).cast("long"))
    return df.join(tested, col)
