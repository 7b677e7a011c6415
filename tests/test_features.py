import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweir.operators import features as D
from logweir.operators.ids import dense_by_number, dense_by_order, running_sum


def vec(ev, **kw):
    return D.feature_vector(ev, **kw).first().features


def seq(make_events, ids, levels=None, start=1, step=1):
    lv = levels or ["INFO"] * len(ids)
    return make_events([(start + i * step, "b", t, lv[i]) for i, t in enumerate(ids)])


def test_entropy(make_events):
    assert vec(seq(make_events, [5] * 5))[1 + 3] == 0.0
    assert vec(seq(make_events, [0, 1, 2] * 2))[3 + 3] == pytest.approx(np.log2(3))


def test_repeat_ratio_and_bigrams(make_events):
    assert vec(seq(make_events, [7] * 4))[1 + 4] == 1.0
    assert vec(seq(make_events, [0, 1, 0, 1]))[2 + 4] == 0.0
    assert vec(seq(make_events, [0, 1, 2, 0]))[3 + 5] == 3.0


def test_levels_and_span(make_events):
    v = vec(seq(make_events, [1, 2, 3, 4], ["INFO", "ERROR", "FATAL", "WARN"]))
    assert v[4 + 6 :] == [2.0, 1.0]
    assert vec(make_events([(10, "b", 1), (20, "b", 2), (50, "b", 3)]))[3 + 2] == 40.0


def test_widths_and_bad_set(make_events):
    ev = seq(make_events, [3, 4, 4])
    assert len(vec(ev)) == 2 + 8 and vec(ev, feature_set="freq_only") == [1.0, 2.0]
    with pytest.raises(ValueError):
        D.feature_vector(ev, "other")


def test_stored_vocabulary_ignores_unseen_templates(make_events, spark):
    vocab = spark.createDataFrame([(1, 0), (9, 1)], "template_id long, col long")
    v = vec(seq(make_events, [1, 1, 2]), vocab=vocab)
    assert v[:2] == [2.0, 0.0] and v[2:4] == [3.0, 2.0]


def test_vocabulary_covers_lines_without_block(make_events):
    ev = make_events([(1, "", 4), (2, "b", 2), (3, "b", -1)])
    assert [tuple(r) for r in D.template_vocab(ev).orderBy("col").collect()] == [(2, 0), (4, 1)]
    assert D.block_stats(ev).first().event_count == 2


def test_pairs_are_stitched_over_line_ranges(make_events):
    rng = random.Random(4)
    rows = [(i, f"b{rng.randint(0, 2)}", rng.randint(0, 2)) for i in range(300)]
    ev = make_events(rows)

    def table(df):
        return {(r.block_id, r.prev, r.cur): r.n for r in df.collect()}

    want = {}
    for b in ("b0", "b1", "b2"):
        s = [t for _, x, t in rows if x == b]
        for p in zip(s, s[1:]):
            want[(b, *p)] = want.get((b, *p), 0) + 1
    for size in (1, 7, 64, 1 << 17):
        assert table(D.adjacent_pairs(ev, line_range=size)) == want


def test_standardize(spark):
    x = np.array([[1.0, 5.0], [2.0, 5.0], [6.0, 5.0]])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, features array<double>")
    got = np.array([r.features for r in D.standardize(df).orderBy("id").collect()])
    assert np.allclose(got[:, 0], (x[:, 0] - 3) / x[:, 0].std()) and np.allclose(got[:, 1], 0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 500), min_size=1, max_size=60), st.integers(1, 40))
def test_dense_numbers(spark, values, bucket):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = {r.v: r.i for r in dense_by_number(df, "v", "i", bucket=bucket).collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted(values))}


def test_dense_by_text_order(spark):
    vals = [f"k{(i * 37) % 101}" for i in range(101)]
    got = {r.k: r.i for r in dense_by_order(spark.createDataFrame([(v,) for v in vals], "k string").repartition(5), ["k"], "i", 0).collect()}
    assert got == {v: i for i, v in enumerate(sorted(vals))}


def test_running_sum(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(50)], "p long, x long")
    got = {r.p: r.s for r in running_sum(df, "p", {"s": "x"}, bucket=8).collect()}
    assert got == {i: sum(j % 5 for j in range(i + 1)) for i in range(50)}
