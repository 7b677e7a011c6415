"""Line deduplication by a segment-partition edit join.

A line is cut into threshold + 1 segments, so two lines within the threshold (one
edit) agree in one of them (Li et al., "PASS-JOIN: a partition-based method for
similarity joins", VLDB 2011).  For one edit and two segments the length-aware
substring index has one substring to probe for each segment and length: a line of n
characters stands in the index under its two halves, and looks for lines of n - 1
characters under theirs.

Lines that share a segment agree there, so the edit is in the rest, and the argument
holds for that too: a bucket with more than PAIRS lines is dealt again by the
halves of the rest (the text before and after a region, and the lengths), until it is
small or the region is one character, where all lines of a bucket are linked to its
first.  Small buckets are paired and verified by banded bit-parallel edit distance.
So no bucket gives more than PAIRS^2 / 2 pairs, and no link is lost.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import fresh, stored
from logweir.operators.components import connected_components

SHORTEST = 20  # code points from which a line may differ by an edit; shorter ones must be equal
PAIRS = 24  # lines of a bucket that are paired
EDITS = 1


def _id() -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b")).alias("id")


def _bare(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, h, no, line): the lines with a word; h tells texts of one id apart."""
    return (_bare(docs).select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
            .where(F.col("line").rlike(r"[^\x20\x09-\x0D]")))


def _keyed(frm: str, to: str) -> tuple[str, str]:
    """SQL: the buckets of a line of n characters for the region [frm, to) of the
    length class it is indexed under (its own), and of the class one shorter, which it
    probes: the hash of class, region, and what stands before and after."""
    def key(less: int) -> str:
        return f"xxhash64(n - {less}, {frm}, {to}, substring(line, 1, {frm}), substring(line, {to} + {less + 1}))"
    return key(0), key(1)


def banded_distance(a: str, b: str, edits: int) -> str:
    """SQL: edit distance of two arrays of characters, a not the shorter, by a bit
    vector over the 2 * edits + 1 diagonals next to the main one (Hyyro, "A bit-vector
    algorithm for computing Levenshtein and Damerau edit distances", 2003).

    Exact up to ``edits``; larger distances give some larger number.  Bit d of eq tells
    if a[j + d - edits] equals b[j]; the score follows the band's lower edge to the last
    row of a, then that row.  Each one-element transform binds a name.
    """
    w = 2 * edits + 1
    mask, edge = (1 << w) - 1, f"(size({a}) - {edits})"
    eq = " + ".join(f"if(j + {d - edits} >= 0 and get({a}, j + {d - edits}) = {b}[j], {1 << d}L, 0L)" for d in range(w))
    row = f"cast(power(2, {w - 2} - j + {edge}) as bigint)"
    score = (f"s.score + if(j < {edge}, if(d0 & {1 << (w - 1)}L = 0, 1, 0), "
             f"if(h.p & {row} != 0, 1, 0) - if(h.n & {row} != 0, 1, 0))")
    after = f"named_struct('vp', (h.n | ~(shiftright(d0, 1) | h.p)) & {mask}L, 'vn', shiftright(d0, 1) & h.p & {mask}L, 'score', {score})"
    sides = f"transform(array(named_struct('p', (s.vn | ~(d0 | s.vp)) & {mask}L, 'n', d0 & s.vp)), h -> {after})[0]"
    zero = f"transform(array(((((eq & s.vp) + s.vp) ^ s.vp) | eq | s.vn) & {mask}L), d0 -> {sides})[0]"
    start = f"named_struct('vp', {mask ^ ((1 << edits) - 1)}L, 'vn', 0L, 'score', {edits})"
    return (f"if(size({a}) - size({b}) > {edits}, {edits + 1}, aggregate(if(size({b}) = 0, cast(array() as array<int>), "
            f"sequence(0, size({b}) - 1)), {start}, (s, j) -> transform(array({eq}), eq -> {zero})[0], s -> s.score))")


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (u, v) of line ids that are one edit apart."""
    side = lambda k: lines.select(F.col("id").alias(k), F.split("line", "").alias(f"{k}_chars"))
    full = pairs.join(side("u"), "u").join(side("v"), "v")
    longer = [F.expr(f"if(size(u_chars) >= size(v_chars), {x}_chars, {y}_chars)").alias(n) for x, y, n in (("u", "v", "p"), ("v", "u", "t"))]
    return full.select("u", "v", *longer).where(F.expr(f"{banded_distance('p', 't', EDITS)} <= {EDITS}")).select("u", "v")


def _halves(n: str) -> list[tuple[int, str, str]]:
    """(less, from, to) of the two segments of the classes that a line stands under."""
    mid = lambda less: f"cast(({n} - {less}) div 2 as int)"
    return [(less, *r) for less in (0, 1) for r in (("0", mid(less)), (mid(less), f"{n} - {less}"))]


def edit_links(lines: DataFrame, texts: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(u, v): links that span the graph of the lines one edit apart.  ``lines`` has
    id, n and keys (by _halves) once for each line, ``texts`` id and line, repeats
    included; the text is only fetched for lines that share a bucket."""
    structs = ", ".join(f"named_struct('own', {'true' if less == 0 else 'false'}, 'frm', {frm}, 'to', {to}, 'key', keys[{k}])" for k, (less, frm, to) in enumerate(_halves("n")))
    rows = lines.where(F.col("n") >= SHORTEST).select("id", F.expr(f"inline(array({structs}))"))
    kept: DataFrame | None = None
    out: list[DataFrame] = []
    while True:
        size = rows.groupBy("key").agg(F.count("*").alias("size"), F.count_if("own").alias("owns")).where("size > 1 and owns > 0")
        met = stored(rows.join(stored(size, "line-bucket-sizes"), "key"), "line-buckets")
        if kept is None:  # the text of the lines that share a bucket; one kind of join, so that costs grow with the input alone
            wanted = stored(met.select("id").distinct(), "line-wanted")
            kept = stored(texts.join(wanted.hint("shuffle_hash"), "id").groupBy("id").agg(F.first("line").alias("line")).withColumn("n", F.length("line")), "line-candidates")
        small = met.where(F.col("size") <= pairs)
        own = small.where("own").select("key", F.col("id").alias("u"))
        two = own.join(small.select("key", "own", F.col("id").alias("v")), "key").where("u <> v and (u < v or not own)").select("u", "v").distinct()
        out.append(stored(_verified(two, kept), "line-links"))
        hot = stored(met.where(F.col("size") > pairs).select("id", "own", "frm", "to", "key"), "hot-lines")
        if hot.isEmpty():
            break
        # a region of one character: lines of one length differ there and nowhere else
        stars = hot.where("own and to - frm = 1").groupBy("key").agg(F.min("id").alias("v"))
        out.append(stored(hot.where("own and to - frm = 1").join(stored(stars, "line-stars"), "key").where("id <> v").select(F.col("id").alias("u"), "v"), "line-links"))
        # no region: the longer line has one character there, all else is equal
        stars = hot.where("own and to = frm").select("key", F.col("id").alias("v"))
        out.append(stored(hot.where("not own and to = frm").join(stars, "key").select(F.col("id").alias("u"), "v"), "line-links"))
        cuts = F.expr("""if(to - frm = 1, array(named_struct('frm', frm, 'to', frm), named_struct('frm', to, 'to', to)),
            array(named_struct('frm', frm, 'to', cast((frm + to) div 2 as int)), named_struct('frm', cast((frm + to) div 2 as int), 'to', to)))""")
        again = hot.where("to > frm").select("id", "own", F.explode(cuts).alias("r")).distinct().join(kept, "id")
        rows = again.select("id", "own", "r.frm", "r.to", "line", "n").select(
            "id", "own", "frm", "to", F.expr(f"if(own, {_keyed('frm', 'to')[0]}, {_keyed('frm', 'to')[1]})").alias("key"))
    links = out[0]
    for x in out[1:]:
        links = links.unionByName(x)
    return links


def repeated_lines(docs: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(doc_id, h, gone): the numbers of the lines of a text that are equal to, or one
    edit from, a line of an earlier document or an earlier line of their own, or linked
    to one by others.  h tells texts of one id apart."""
    lines = lines_of(docs).select("doc_id", "h", "no", "line", _id(), F.length("line").alias("n"))
    keys = F.expr(f"if(n >= {SHORTEST}, array({', '.join(_keyed(frm, to)[less] for less, frm, to in _halves('n'))}), null)")
    occ = stored(lines.select("doc_id", "h", "no", "id", "n", keys.alias("keys")), "lines")
    first = occ.groupBy("id").agg(F.min(F.struct("doc_id", "h", "no")).alias("at"), F.count("*").alias("times"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    first = stored(first, "first-lines")
    links = edit_links(first.select("id", "n", "keys"), lines.where(F.col("n") >= SHORTEST).select("id", "line"), pairs)
    comps = connected_components(links)
    rooted = first.join(comps.withColumnRenamed("node", "id"), "id", "left").where("times > 1 or root is not null").select("id", "at", F.coalesce("root", "id").alias("root"))
    rooted = stored(rooted, "line-classes")
    heads = stored(rooted.groupBy("root").agg(F.min("at").alias("head")), "line-heads")
    classes = stored(rooted.join(heads, "root").select("id", "head"), "line-first")
    gone = occ.join(classes, "id").where(F.struct("doc_id", "h", "no") != F.col("head"))
    return stored(gone.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("no")).alias("gone")), "repeated-lines")


def without_repeated_lines(docs: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """``docs`` with n_lines (lines with a word), n_removed and the text without its
    repeated lines; blank lines stay.

    A null text stays null, with no lines.  A null doc_id stands before all others.
    Rows that repeat a doc_id and its text count once, and each gets the result;
    different texts of one doc_id are ordered by their hash.  An empty table gives none.
    Columns of these names in ``docs`` are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    key, i, h, g = fresh(docs, "_k", "_id", "_h", "_gone")
    gone = repeated_lines(docs, pairs).select(F.col("doc_id").alias(i), F.col("h").alias(h), F.col("gone").alias(g))
    joined = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")))).join(
        gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(key) == F.col(h)), "left")
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    left = F.expr(f"array_join(filter(split(text, '\n'), (x, no) -> not array_contains({g}, no)), '\n')")
    out = joined.withColumns({"n_lines": n, "n_removed": F.coalesce(F.size(g), F.lit(0)).cast("long")})
    out = out.withColumn("text", F.when(F.col(g).isNull(), F.col("text")).otherwise(left))
    return out.select(*docs.columns, "n_lines", "n_removed")
