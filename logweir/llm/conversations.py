"""Repair of damaged conversations by a square-root checkpointed dynamic program.

A conversation is right if its role initials are ``(s?(ua)+)?``.  Each row is kept (0), given the role user or
assistant (2) or deleted (3, and nothing else for blank and duplicate rows); user and assistant turns without
text are put in (2); a truncated row that stays costs 1.  The cheapest edits are emitted, of equal ones those
whose initials are least as ASCII.

1. The rows are put in order once, by range (no conversation has to fit a partition), and numbered.
2. Each row becomes one byte: its role's initial, whether it has to go, whether it is truncated.  A block holds
   as many bytes as the square root of the rows, so there are as many blocks as a block has rows: neither
   grows beyond that root, whatever share of the rows one conversation has.
3. A block's part of a conversation is a (min, +) product of its rows' steps between the four states.  Backward
   state costs are kept at the block borders only (checkpoints), found by going back over those products.
4. Each block then recomputes its own vectors from its checkpoint and walks forward over tight edits, least
   initial first.  Parts of conversations that go over a border are walked from all four states first, so
   that the state in which they are entered is known, and then once more.

Defined results: rows of one turn stand in the order of role and text (null turns first); a null role or text
is one space and so blank or of no legal role; a null conv_id is a conversation; repeated rows are duplicates; an
empty table gives no rows; other columns are ignored.  Texts of any length: only their order, last character and
digest are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import stored

KEEP, ROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: States: nothing yet, after system, after user, after assistant.  Those a conversation may end in; what a new
#: or changed turn leads to; what a kept row of a role leads to.
_STATES = range(4)
_END = (0, None, None, 0)
_NEXT = (2, 2, 3, 2)
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_NEW_ROLE = (None, None, "user", "assistant")
_FAR = 1 << 60
_EDITS = "DIKR"  # in ASCII order

BLANKS = " \t\n\x0b\f\r"


def _kind(initial: str, gone: bool, truncated: bool) -> int:
    return ("sua".find(initial) + 1 if initial else 0) + 4 * truncated + 8 * gone


def _moves(kind: int) -> list[dict[str, tuple[int, int]]]:
    """For each state the edits of a row of this kind, with cost and next state."""
    out = []
    more = TRUNCATED if kind & 4 else 0
    for s in _STATES:
        edits = {"D": (DELETE, s)}
        if not kind & 8:
            to = _KEPT.get(" sua"[kind & 3], {}).get(s)
            if to is not None:
                edits["K"] = (KEEP + more, to)
            edits["R"] = (ROLE + more, _NEXT[s])
        out.append(edits)
    return out


_MOVES = [_moves(k) for k in range(16)]


def _with_inserts(v: list[int]) -> list[int]:
    """Costs where turns may be put in first; three steps reach every state."""
    for _ in range(3):
        v = [min(v[s], INSERT + v[_NEXT[s]]) for s in _STATES]
    return v


LAST = _with_inserts([_FAR if c is None else c for c in _END])


def back(kind: int, v: list[int]) -> list[int]:
    """Costs before a row from those after it."""
    return _with_inserts([min(c + v[t] for c, t in edits.values()) for edits in _MOVES[kind]])


def product(kinds: bytes) -> list[int]:
    """Least cost from each state before the rows to each state after them, as 16 numbers."""
    columns = []
    for t in _STATES:
        v = [0 if s == t else _FAR for s in _STATES]
        for k in reversed(kinds):
            v = back(k, v)
        columns.append([min(c, _FAR) for c in v])
    return [columns[t][s] for s in _STATES for t in _STATES]


def through(m: list[int], v: list[int]) -> list[int]:
    return [min(m[4 * s + t] + v[t] for t in _STATES) for s in _STATES]


def vectors(kinds: bytes, after: list[int]) -> list[list[int]]:
    """Costs before each row of a block, and after the last one, from its checkpoint."""
    out = [after]
    for k in reversed(kinds):
        out.append(back(k, out[-1]))
    return out[::-1]


def walk(kinds: bytes, costs: list[list[int]], s: int, ends: bool) -> tuple[list[tuple[str, str, str]], int]:
    """(turns put in before, edit, turns put in after) of each row, and the state at the end; ``ends``: no row of
    the conversation follows, so the last row also has what is put in at the end."""
    out = []
    for k, before, v in zip(kinds, costs, costs[1:]):
        put, left = "", before[s]
        while True:
            edits = {e: (c + v[t], t) for e, (c, t) in _MOVES[k][s].items()} | {"I": (INSERT + before[_NEXT[s]], _NEXT[s])}
            e = next(e for e in _EDITS if e in edits and edits[e][0] == left)
            s, left = edits[e][1], left - INSERT
            if e != "I":
                break
            put += " sua"[s]
        out.append((put, e + " sua"[s], ""))
    if ends and out:
        put = ""
        while LAST[s]:
            s = _NEXT[s]
            put += " sua"[s]
        out[-1] = (*out[-1][:2], put)
    return out, s


# -- on Spark ------------------------------------------------------------------------------

_BLOCKS = "block long, kinds binary, lengths array<int>, opens boolean, closes boolean"


def in_order(rows: DataFrame) -> DataFrame:
    """(at, conv_id, turn, role, text) with ``at`` dense along conversation, turn, role and text."""
    space = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    keys = ["conv_id", "turn", "role", "text", "tie"]
    sorted_ = rows.select("conv_id", "turn", *space, F.monotonically_increasing_id().alias("tie")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = stored(sorted_.drop("tie").withColumn("at", F.monotonically_increasing_id()), "turns")
    part = F.shiftright("at", 33)
    counts = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("low")).sort("part").collect()
    shifts, before = [], 0  # one entry a range partition
    for p, n, low in counts:
        shifts.append((p, before - low))
        before += n
    shift = rows.sparkSession.createDataFrame(shifts, "part long, shift long")
    return kept.withColumn("part", part).join(F.broadcast(shift), "part").select((F.col("at") + F.col("shift")).alias("at"), "conv_id", "turn", "role", "text")


def faults(turns: DataFrame) -> DataFrame:
    """(at, conv_id, turn, role, fault): the first fault of each row, or null."""
    tail = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    said = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    seen = turns.select("at", "conv_id", said.alias("said"))
    first = seen.groupBy("conv_id", "said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    bare = turns.select("at", "conv_id", "turn", "role", tail.alias("tail"))
    fault = F.when(F.col("tail") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("tail").isin(".", "!", "?"), "truncated")
    return bare.join(first, "at", "left").select("at", "conv_id", "turn", "role", fault.alias("fault"))


def _blocks(kinds: DataFrame, length: int) -> DataFrame:
    """One row a block: its rows' kinds, the lengths of its conversations' parts, and whether the first of them
    began, the last of them goes on, in another block."""
    one = F.struct("at", "conv_id", "kind")
    cut = kinds.groupBy(F.floor(F.col("at") / length).cast("long").alias("block")).agg(F.sort_array(F.collect_list(one)).alias("r"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for block, r in zip(b.column("block").to_pylist(), b.column("r").to_pylist()):
                ids = [x["conv_id"] for x in r]
                cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
                out.append({"block": block, "kinds": bytes(x["kind"] for x in r), "lengths": [y - x for x, y in zip(cuts, cuts[1:])], "first": ids[0], "last": ids[-1]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int64()), ("kinds", pa.binary()), ("lengths", pa.list_(pa.int32())), ("first", ids_type(b)), ("last", ids_type(b))]))

    def ids_type(b: pa.RecordBatch) -> pa.DataType:
        return b.schema.field("r").type.value_type.field("conv_id").type

    kind = kinds.schema["conv_id"].dataType.simpleString()
    whole = stored(cut.mapInArrow(packed, f"block long, kinds binary, lengths array<int>, first {kind}, last {kind}"), "turn-blocks")
    # the blocks before and after, by number: no window over all of them
    ends = whole.select((F.col("block") + 1).alias("block"), F.struct(F.col("last").alias("id")).alias("before"))
    starts = whole.select((F.col("block") - 1).alias("block"), F.struct(F.col("first").alias("id")).alias("after"))
    near = whole.join(ends, "block", "left").join(starts, "block", "left")
    return near.select(
        "block", "kinds", "lengths",
        (F.col("before").isNotNull() & F.col("first").eqNullSafe(F.col("before.id"))).alias("opens"),
        (F.col("after").isNotNull() & F.col("last").eqNullSafe(F.col("after.id"))).alias("closes"))


def _parts(b: dict) -> list[tuple[bytes, bool, bool]]:
    """(kinds, began before, goes on) of each conversation's part of a block."""
    out, at, n = [], 0, len(b["lengths"])
    for i, size in enumerate(b["lengths"]):
        out.append((b["kinds"][at : at + size], i == 0 and b["opens"], i == n - 1 and b["closes"]))
        at += size
    return out


def _chains(borders: DataFrame) -> DataFrame:
    """Blocks whose border a conversation crosses, by conversation: ``chain`` is the block it begins in, which is
    the last block before that its own did not come from.  There are at most as many rows as blocks, the square
    root of the turns."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = None
        for b in batches:
            ids, chains = b.column("block").to_pylist(), []
            for block, opens, through_ in zip(ids, b.column("opens").to_pylist(), b.column("whole").to_pylist()):
                chains.append(chain if opens else None)
                chain = chain if opens and through_ else block
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chains, pa.int64())], [*b.schema.names, "chain"])

    schema = "block long, opens boolean, closes boolean, whole boolean, product_first array<long>, product_last array<long>"
    return borders.coalesce(1).sortWithinPartitions("block").mapInArrow(joined, f"{schema}, chain long")


def checkpoints(blocks: DataFrame) -> DataFrame:
    """(block, after_first, after_last, enter): the backward costs after a block's first and last part, and the state
    in which its first part is entered, as far as they are not those of a whole conversation."""
    crossing = blocks.where(F.col("opens") | F.col("closes"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                parts = _parts(b)
                out.append({"block": b["block"], "opens": b["opens"], "closes": b["closes"], "whole": len(parts) == 1 and b["closes"],
                            "product_first": product(parts[0][0]) if b["opens"] else None, "product_last": product(parts[-1][0]) if b["closes"] else None})
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int64()), *[(c, pa.bool_()) for c in ("opens", "closes", "whole")], ("product_first", longs), ("product_last", longs)]))

    schema = "block long, opens boolean, closes boolean, whole boolean, product_first array<long>, product_last array<long>"
    links = stored(_chains(crossing.mapInArrow(products, schema)), "turn-products")

    # the blocks of a conversation: where it begins, and all that it goes on in
    heads = links.where(F.col("closes") & ~F.coalesce(F.col("whole") & F.col("opens"), F.lit(False)))
    chains = heads.select(F.col("block").alias("chain"), "block", F.lit(None).cast("array<long>").alias("product")).unionByName(
        links.where("opens").select("chain", "block", F.col("product_first").alias("product")))

    def backward(key: tuple, table: pa.Table) -> pa.Table:
        v, rows = LAST, []
        for r in sorted(table.to_pylist(), key=lambda r: -r["block"]):
            rows.append({"chain": r["chain"], "block": r["block"], "after": v})
            if r["product"] is not None:
                v = through(r["product"], v)
        return pa.Table.from_pylist(rows, pa.schema([("chain", pa.int64()), ("block", pa.int64()), ("after", pa.list_(pa.int64()))]))

    after = stored(chains.groupBy("chain").applyInArrow(backward, "chain long, block long, after array<long>"), "turn-checkpoints")

    # where each part of a crossing conversation leaves from each state
    first = after.where(F.col("chain") != F.col("block")).select("block", F.col("after").alias("after_first"))
    last = after.where(F.col("chain") == F.col("block")).select("block", F.col("after").alias("after_last"))
    known = crossing.join(first, "block", "left").join(last, "block", "left")

    def leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                parts = _parts(b)
                for kinds, v, states, own in ((parts[0][0], b["after_first"], _STATES, False), (parts[-1][0], b["after_last"], (0,), True)):
                    if v is not None:
                        costs = vectors(kinds, v)
                        out.append({"block": b["block"], "own": own, "to": [walk(kinds, costs, s, False)[1] for s in states]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int64()), ("own", pa.bool_()), ("to", pa.list_(pa.int32()))]))

    moves = known.mapInArrow(leaving, "block long, own boolean, to array<int>")
    moves = moves.join(after.select("block", "chain", (F.col("block") == F.col("chain")).alias("own")), ["block", "own"])

    def forward(key: tuple, table: pa.Table) -> pa.Table:
        s, rows = 0, []
        for r in sorted(table.to_pylist(), key=lambda r: r["block"]):
            if not r["own"]:
                rows.append({"block": r["block"], "enter": s})
            s = r["to"][0 if r["own"] else s]
        return pa.Table.from_pylist(rows, pa.schema([("block", pa.int64()), ("enter", pa.int32())]))

    entered = moves.groupBy("chain").applyInArrow(forward, "block long, enter int")
    return known.select("block", "after_first", "after_last").join(entered, "block", "left")


_EMITTED = pa.schema([("at", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("new_role", pa.string())])


def _emitted(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The edits of each row of a block, those put in before and after it among them."""
    for batch in batches:
        for b in batch.to_pylist():
            out, at = [], b["block"] * length
            for kinds, before, more in _parts(b):
                v = LAST if not more and not before else b["after_first"] if before else b["after_last"]
                for put, edit, end in walk(kinds, vectors(kinds, v), b["enter"] if before else 0, not more)[0]:
                    turns = [*(("I", s) for s in put), (edit[0], edit[1] if edit[0] == "R" else None), *(("I", s) for s in end)]
                    out += [{"at": at, "step": i, "edit": e, "new_role": _NEW_ROLE[" sua".index(s)] if s else None} for i, (e, s) in enumerate(turns)]
                    at += 1
            yield pa.RecordBatch.from_pylist(out, _EMITTED)


def repair(rows: DataFrame) -> DataFrame:
    """The cheapest edits of (conv_id, turn, role, text) rows: one row an edit, (conv_id, at, step, edit, turn, was,
    fault, role, text), in the order of at and step.  ``edit`` is Keep, Rerole, Delete or Insert by its initial;
    ``was`` is the role before (null for what is put in), ``role`` and ``text`` are those after."""
    turns = in_order(rows)
    seen = stored(faults(turns), "turn-faults")
    length = max(1, math.isqrt(seen.count()))
    gone = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    cut = F.coalesce(F.col("fault") == "truncated", F.lit(False))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0) + F.when(cut, 4).otherwise(0) + F.when(gone, 8).otherwise(0)
    blocks = stored(_blocks(seen.select("at", "conv_id", kind.alias("kind")), length), "turn-blocks")
    known = blocks.join(stored(checkpoints(blocks), "turn-states"), "block", "left")
    edits = known.mapInArrow(lambda batches: _emitted(batches, length), "at long, step int, edit string, new_role string")
    put = F.col("edit") == "I"
    out = edits.join(seen.select("at", "conv_id", "turn", F.col("role").alias("was"), "fault"), "at").join(turns.select("at", "text"), "at")
    own = [F.when(~put, F.col(c)).alias(c) for c in ("turn", "was", "fault")]
    return out.select("conv_id", "at", "step", "edit", *own, F.coalesce("new_role", "was").alias("role"), F.when(put, "").otherwise(F.col("text")).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted damage, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes
    its sentence ends, 3 repeats it, 4 makes its role user.  A null is one space."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    h = F.crc32(F.concat_ws(":", told[0], told[1])) % 20
    out = rows.select("conv_id", "turn", told[2].alias("role"), told[3].alias("text"), h.alias("h")).where("h != 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def digests(edits: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of a repair's edits.  Rows
    stream past in order; of a conversation only counts, a running hash and the initials of its edits are held."""
    import hashlib

    dealt = edits.repartition("conv_id").sortWithinPartitions("conv_id", "at", "step")
    id_type = edits.schema["conv_id"].dataType.simpleString()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out, schema = None, [], None

        def close() -> None:
            if state:
                gaps = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
                out.append({**{c: state[c] for c in counts}, "conv_id": state["conv_id"], "gaps": gaps, "audit": "".join(state["audit"]), "repaired_sha256": state["sha"].hexdigest()})

        for b in batches:
            schema = pa.schema([("conv_id", b.schema.field("conv_id").type), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for conv, edit, turn, was, fault, role, text in zip(*[b.column(c).to_pylist() for c in ("conv_id", "edit", "turn", "was", "fault", "role", "text")]):
                if state is None or state["conv_id"] != conv:
                    close()
                    state = {**dict.fromkeys(counts, 0), "conv_id": conv, "low": None, "high": None, "turns": 0, "was": None, "audit": [], "sha": hashlib.sha256(), "any": False}
                state["audit"].append(edit)
                if edit != "I":
                    if turn is not None and turn != state["high"]:
                        state["low"] = turn if state["low"] is None else state["low"]
                        state["high"], state["turns"] = turn, state["turns"] + 1
                    if fault:
                        state[fault] += 1
                    if state["was"] is not None and state["was"] + was[:1] not in ("su", "ua", "au"):
                        state["illegal"] += 1
                    state["was"] = was[:1]
                state["cost"] += {"K": KEEP, "R": ROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if edit != "D" and fault == "truncated" else 0)
                if edit != "D":
                    state["sha"].update(f"{chr(10) if state['any'] else ''}{role}:{text}".encode())
                    state["any"] = True
            if len(out) > 5_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = f"conv_id {id_type}, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string"
    return dealt.mapInArrow(streamed, schema)
