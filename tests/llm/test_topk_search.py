import math

import numpy as np
from compare import connect, difference
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadflow.llm import queries
from leadflow.llm.topk_search import SlicedBlock, quantised, top_k

SF = "/root/testdata/sf0.001"


def best(rows, asks, k):
    """All pairs: (query, rank, id, score)."""
    out = []
    for q, v in rows.items():
        if asks(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows.items() if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_oracle(spark):
    con = connect(SF)
    assert difference(queries.op1_topk_search(spark, SF), con, queries.OP1_SQL) is None


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.lists(st.integers(-300, 300), min_size=3, max_size=3), min_size=1, max_size=90),
    st.lists(st.integers(-300, 300), min_size=3, max_size=3), st.integers(1, 7),
)
def test_block_equals_all_products(vectors, query, k):
    block = SlicedBlock.of(np.arange(len(vectors)), np.array(vectors))
    ids, scores = block.top(2, np.array(query), k)
    order = sorted((-int(np.dot(v, query)), i) for i, v in enumerate(vectors) if i != 2)[:k]
    assert sorted(zip((-scores).tolist(), ids.tolist())) == order


def test_ties_blocks_and_fewer_rows(spark):
    rows = {i: [i % 3 - 1, 5, -(i % 2)] for i in range(100)}
    df = spark.createDataFrame([(i, v) for i, v in rows.items()], "vec_id long, v array<int>")
    got = collected(top_k(df, F.col("vec_id") % 10 == 0, 5, block_rows=16))
    assert got == best(rows, lambda q: q % 10 == 0, 5)
    few = top_k(df.where("vec_id < 3"), F.col("vec_id") == 0, 5)
    assert len(few.collect()) == 2


def all_rows(rows, k):
    """All pairs of rows, which may share ids: (query, rank, id, score)."""
    out = []
    for i, (q, v) in enumerate(rows):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), r) for j, (r, w) in enumerate(rows) if j != i and len(w) == len(v))
        out += [(q, n + 1, r, -s if -(1 << 63) <= -s < 1 << 63 else None) for n, (s, r) in enumerate(scored[:k])]
    return sorted(out, key=str)


def test_odd_rows(spark):
    rows = [
        (0, [0.5, 0.25]), (1, None), (2, [1.0, None]), (3, [math.nan, 1.0]), (4, [math.inf, 0.0]), (5, [-0.001, 0.3]),
        (5, [-0.001, 0.3]), (5, [0.5, 0.0]), (None, [1.0, 1.0]), (6, []), (7, [1.0, 1.0, 1.0]), (8, [0.5, 0.25]),
        (9, [300_000.0, 0.0]), (10, [-4e6, 2e12]), (11, [1e30, 0.0]),
    ]
    ddl = "vec_id long, embedding array<double>, block string, at string, key string, id string"
    df = spark.createDataFrame([(*r, *"xxxx") for r in rows], ddl)
    own = df.select("vec_id", quantised("embedding").alias("v"))
    got = sorted((tuple(r) for r in top_k(own, F.col("vec_id") >= 0, 5).collect()), key=str)
    usable = [
        (0, [128, 64]), (5, [-1, 76]), (5, [-1, 76]), (5, [128, 0]), (8, [128, 64]), (7, [256] * 3), (9, [76_800_000, 0]),
        (10, [-1_024_000_000, 512_000_000_000_000]),
    ]
    assert got == all_rows(usable, 5)
    assert top_k(own.where("vec_id < 0"), F.lit(True)).collect() == []


def test_wide_sums_rank_exactly(spark):
    draw = np.random.default_rng(2)
    rows = [(int(i % 30), [int(x) for x in draw.integers(-(1 << 52), 1 << 52, 3)]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = sorted((tuple(r) for r in top_k(df, F.lit(True), 4, block_rows=16).collect()), key=str)
    assert got == all_rows(rows, 4) and any(r[3] is None for r in got)


def test_a_common_id_does_not_gather_in_one_block(spark):
    df = spark.createDataFrame([(7, [i % 9, 1]) for i in range(300)] + [(8, [1, 1])], "vec_id long, v array<long>")
    got = top_k(df, F.col("vec_id") == 8, 3, block_rows=32).collect()
    assert sorted(tuple(r) for r in got) == [(8, 1, 7, 9), (8, 2, 7, 9), (8, 3, 7, 9)]


def test_weights_of_any_sign():
    block = SlicedBlock.of(np.arange(70), np.arange(-210, 0).reshape(70, 3))
    sums, added = block.scores(np.array([-7, 0, 123]))
    value = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:70].astype(int) << i for i, s in enumerate(sums))
    assert (value + added == np.arange(-210, 0).reshape(70, 3) @ [-7, 0, 123]).all()
