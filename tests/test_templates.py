import os
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logweir.operators import template_quality as Q
from logweir.operators import templates as T


def strict_tree(lines, sim_th=0.4, depth=4, max_children=100):
    """Plain line-at-a-time fixed-depth tree, written from the paper."""
    leaves, children, clusters, out = {}, {}, [], []
    for line in lines:
        toks = line.split()
        path = (len(toks),)
        for t in toks[: min(depth - 3, len(toks) - 1)]:
            kids = children.setdefault(path, set())
            if re.search(r"\d", t):
                key = "<*>"
            elif t in kids or len(kids - {"<*>"}) < max_children - 1:
                key = t
            else:
                key = "<*>"
            kids.add(key)
            path = (*path, key)
        best, best_rank = None, None
        for c in leaves.setdefault(path, []):
            tpl = clusters[c]
            sim = sum(a == b for a, b in zip(tpl, toks) if a != "<*>") / len(toks)
            rank = (sim, sum(a == "<*>" for a in tpl))
            if best is None or rank > best_rank:
                best, best_rank = c, rank
        if best is not None and best_rank[0] >= sim_th:
            clusters[best] = [a if a == b else "<*>" for a, b in zip(clusters[best], toks)]
        else:
            best = len(clusters)
            clusters.append(toks)
            leaves[path].append(best)
        out.append(best + 1)
    return [" ".join(c) for c in clusters], out


def as_events(spark, lines):
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(lines)], "line_id long, content string")


def separated(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = rng.randint(1, 999), rng.choice(["alpha", "beta", "gamma"])
        out.append(rng.choice([
            f"opened session {a} for user {b}",
            f"closed session {a}",
            f"block {a} of size {a * 2} stored by {b} on port 8080",
            "shutdown requested",
            f"retry {a} of 5 failed after timeout",
        ]))
    return out


def test_equals_the_sequential_tree_on_separated_lines(spark):
    lines = separated()
    want, ids = strict_tree(lines)
    ev = as_events(spark, lines)
    tpl = T.mine_templates(ev)
    got = {r.template_id: r.template for r in tpl.collect()}
    assert [got[i] for i in sorted(got)] == want
    found = {r.line_id: r.template_id for r in T.assign_templates(ev, tpl).collect()}
    assert [found[i + 1] for i in range(len(lines))] == ids


def test_gap_to_the_sequential_tree_on_word_soup(spark):
    rng = random.Random(3)
    words = ["read", "write", "sync", "disk", "node", "pool", "job"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 5))) for _ in range(300)]
    _, ids = strict_tree(lines)
    ev = as_events(spark, lines)
    a = T.assign_templates(ev, T.mine_templates(ev)).select("line_id", F.col("template_id").alias("a"))
    b = spark.createDataFrame([(i + 1, t) for i, t in enumerate(ids)], "line_id long, b long")
    assert Q.adjusted_rand(a.join(b, "line_id"), "a", "b").first().ari > 0.4


def test_result_does_not_depend_on_partitioning(spark):
    ev = as_events(spark, separated(200, 5))
    a = T.mine_templates(ev.repartition(1)).collect()
    b = T.mine_templates(ev.repartition(7)).collect()
    assert sorted(a) == sorted(b)


def leaders_in_order(rows, sim_th):
    """(leader, template) of token rows, one after another."""
    leaders, owner = [], []
    for i, t in enumerate(rows):
        same = [(sum(a == b != "<*>" for a, b in zip(rows[j], t)), -j) for j in leaders]
        best = max(same, default=(0, 0))
        if best[0] < max(1, sim_th * len(t)):
            leaders.append(i)
            best = (0, -i)
        owner.append(-best[1])
    common = {j: [x if len({r[p] for r, o in zip(rows, owner) if o == j}) == 1 else "<*>" for p, x in enumerate(rows[j])] for j in leaders}
    return sorted({" ".join(t) for t in common.values()})


def soup(n, width, words, seed):
    rng = random.Random(seed)
    return ["start " + " ".join(rng.choice(words) for _ in range(width - 1)) for _ in range(n)]


@pytest.mark.parametrize("sim_th", [0.4, 0.7])
def test_leaves_of_any_size_give_the_same_templates(spark, monkeypatch, sim_th):
    """One leaf of word soup, settled at once and in many batches and chunks."""
    lines = soup(400, 6, ["read", "write", "sync", "disk", "node", "pool", "job", "lock"], 3)
    ev = as_events(spark, lines)
    rows = [x.split() for x in dict.fromkeys(lines)]
    want = leaders_in_order(rows, sim_th)
    assert len(want) > 2
    for chunk in (5_000, 100, 60):
        monkeypatch.setattr(T, "LEAF_CHUNK", chunk)
        found = T.mine_templates(ev, sim_th).collect()
        assert sorted(r.template for r in found) == want
        assert sum(r["size"] for r in found) == len(lines)


def test_large_leaves_with_stored_templates(spark, monkeypatch):
    """Stored templates of one leaf lead in every batch and keep their ids."""
    lines = soup(300, 5, ["read", "write", "sync", "disk", "node"], 8)
    first = T.mine_templates(as_events(spark, lines[:100]), 0.7)
    more = as_events(spark, lines[100:])
    whole = sorted(T.mine_templates(more, 0.7, seed=first).collect())
    monkeypatch.setattr(T, "LEAF_CHUNK", 50)
    assert sorted(T.mine_templates(more, 0.7, seed=first).collect()) == whole
    old = {r.template_id for r in first.collect()}
    assert old <= {r.template_id for r in whole} and sum(r["size"] for r in whole) == 300


def test_closest_leader_against_all_pairs():
    rng = random.Random(4)
    rows = [[rng.choice(["<*>", "a", "b", "c", "d"]) for _ in range(5)] for _ in range(200)]
    import numpy as np
    import pandas as pd

    codes, heads = T._codes(pd.Series(rows), pd.Series(rows[::3]))
    rank, head_rank = np.arange(200), np.arange(0, 200, 3)
    for least in (1, 2, 4, 5):
        for pairs in (10, 1 << 20):
            T.PAIRS, before = pairs, T.PAIRS
            same, owner = T.closest(codes, rank, heads, head_rank, least)
            T.PAIRS = before
            for i, r in enumerate(rows):
                best = max([(sum(a == b != "<*>" for a, b in zip(rows[j], r)), -j) for j in range(0, i, 3)], default=(0, 1))
                assert (same[i], owner[i]) == ((best[0], -best[1]) if best[0] >= least else (0, -1))


def test_digits_that_never_vary_stay_literal(spark):
    ev = as_events(spark, ["listening on 8080 pid 1", "listening on 8080 pid 2"])
    assert [r.template for r in T.mine_templates(ev).collect()] == ["listening on 8080 pid <*>"]


def test_overflowing_children_share_the_wildcard_child(spark, monkeypatch):
    monkeypatch.setattr(T, "MAX_CHILDREN", 3)
    ev = as_events(spark, [f"{w} is ready now" for w in ("aa", "bb", "cc", "dd")])
    assert {r.template for r in T.mine_templates(ev).collect()} == {"aa is ready now", "bb is ready now", "<*> is ready now"}


def test_seeded_mining_keeps_ids(spark):
    first = T.mine_templates(as_events(spark, ["open file 1 now", "open file 2 now", "close all"]))
    more = as_events(spark, ["open file 3 now", "open dir 4 now", "brand new message here today"])
    got = {r.template_id: r.template for r in T.mine_templates(more, seed=first).collect()}
    assert got == {1: "open <*> <*> now", 2: "close all", 3: "brand new message here today"}


def test_assign_against_brute_force(spark):
    rng = random.Random(9)
    toks = ["a", "b", "7", "8", "<*>"]
    tpls = [[rng.choice(toks) for _ in range(rng.randint(1, 4))] for _ in range(30)]
    lines = [" ".join(rng.choice(toks[:4]) for _ in range(rng.randint(1, 4))) for _ in range(150)]

    def best(line):
        t = line.split()
        hits = [(-sum(x == "<*>" for x in tp), i) for i, tp in enumerate(tpls)
                if len(tp) == len(t) and all(x in ("<*>", y) for x, y in zip(tp, t))]
        return min(hits)[1] if hits else -1

    cat = spark.createDataFrame([(i, t, " ".join(t)) for i, t in enumerate(tpls)], "template_id long, tokens array<string>, template string")
    got = {r.line_id: r for r in T.assign_templates(as_events(spark, lines), cat).collect()}
    assert [got[i + 1].template_id for i in range(len(lines))] == [best(x) for x in lines]
    assert all(r.template == r.content for r in got.values() if r.template_id == -1)


@pytest.mark.parametrize("more", [0, 400])
def test_catalog_takes_the_first_hit(spark, more):
    # one engine for catalogs of any size, so the same texts match in both
    rows = [(0, "(?i)(?d)open .*"), (1, "(?i)(?d)open file"), (2, "(?i)\u00e9chec disk")]
    cat = spark.createDataFrame(rows + [(3 + i, f"never {i} here") for i in range(more)], "idx long, regex string")
    lines = ["OPEN FILE", "open", "reopen it", "\u00c9CHEC disk 1"]
    got = {r.content: r.gt_id for r in T.assign_catalog(as_events(spark, lines), cat).collect()}
    assert got == {"OPEN FILE": 0, "open": -1, "reopen it": 0, "\u00c9CHEC disk 1": -1}


def test_quality_metrics(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, -1)], "line_id long, template_id long")
    assert Q.coverage(df).first()[0] == 0.75
    assert Q.template_entropy(df).first()[0] == pytest.approx(0.9182958, abs=1e-6)
    assert Q.convergence(df).first()[0] == 0.5
    tpl = spark.createDataFrame([(["a", "<*>"],), (["b"],), ([],)], "tokens array<string>")
    assert Q.wildcard_density(tpl).first()[0] == 0.25


def test_ari_goldens(spark):
    rows = [(0, 0), (0, 0), (1, 1), (1, 2)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert Q.adjusted_rand(df, "a", "b").first().ari == pytest.approx(0.5714285714)
    assert Q.adjusted_rand(df, "a", "a").first().ari == 1.0


def test_tuning_rows(spark):
    lines = spark.createDataFrame([(i + 1, f"1 2 INFO c: {t}") for i, t in enumerate(separated(120, 2))], "line_id long, raw string")
    cat = spark.createDataFrame([(0, "(?i)(?d)session"), (1, "(?i)(?d)block")], "idx long, regex string")
    out = Q.rank_combos(Q.sweep_templates(spark, lines, (0.4, 0.6), (3, 4), catalog=cat)).collect()
    assert len(out) == 4 and [r["rank"] for r in out] == [1, 2, 3, 4]
    assert sum(r.is_best for r in out) == 1 and sum(r.is_best_ari for r in out) == 1
    assert all(r.coverage_rate == 1.0 for r in out)
    for r in out:
        want, ids = strict_tree(separated(120, 2), r.sim_th, r.depth)
        assert r.n_templates == len(want)


def test_mining_sends_a_text_once_and_keeps_one_row_a_leader(spark, monkeypatch):
    """Lines are counted by the hash of their signature, rounds of a large leaf leave one table, whole leaves come back as leaders."""
    rows = [(i, f"go {'abcdefgh'[i % 8]} {i % 4} {'uvw'[i % 3]} {'pqrst'[i % 5]} {'xyz'[i % 7 % 3]}") for i in range(60)]
    ev = T.with_signature(spark.createDataFrame(rows, "line_id long, content string"))
    plan = T.distinct_signatures(ev)._jdf.queryExecution().optimizedPlan().toString()
    keys = [x.split("Aggregate [", 1)[1].split("],")[0] for x in plan.split("\n") if "Aggregate [" in x]
    assert keys and not any("signature" in x or "regexp" in x for x in keys)
    want = sorted((tuple(r.tokens), r["size"], r.first_line) for r in T.mine_templates(ev).collect())
    assert sum(n for _, n, _ in want) == 60 and any(T.W in t for t, _, _ in want)
    stored, real = [], T.materialize
    monkeypatch.setattr(T, "LEAF_CHUNK", 5)
    monkeypatch.setattr(T, "materialize", lambda df, name, *how: stored.append((name, real(df, name, *how))) or stored[-1][1])
    assert sorted((tuple(r.tokens), r["size"], r.first_line) for r in T.mine_templates(ev).collect()) == want
    rounds = [df for name, df in stored if name == "open-rows"]
    folders = [os.path.dirname(f[len("file:"):]) for df in rounds for f in df.inputFiles()[:1]]
    assert len(folders) > 1 and [os.path.exists(f) for f in folders] == [False] * (len(folders) - 1) + [True]
    pdf = pd.DataFrame({
        "leaf": ["l"] * 3, "sim_th": 0.4, "text": ["a b c", "a b d", "x y z"], "size": [2, 3, 1],
        "first_line": [5, 4, 9], "seed_id": [-1, -1, -1], "bucket": 0})
    out = T._settled(pdf, ["leaf"])
    assert [(r.text, r.size, r.first_line) for r in out.itertuples()] == [(f"a b {T.W}", 5, 4), ("x y z", 1, 9)]
