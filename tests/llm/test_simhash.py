import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadflow.llm import queries, simhash
from leadflow.llm.common import components

SF = "/root/testdata/sf0.001"


def plain(text, words=3):
    """The fingerprint by its definition, bit by bit."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    parts = [w for w in low.split(" ") if w]
    if not parts:
        return 0
    grams = [parts] if len(parts) < words else [parts[i : i + words] for i in range(len(parts) - words + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(links):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {x: top(x) for x in list(parent)}


def expected(rows):
    """(doc_id, fingerprint, component) by comparing all pairs."""
    fps = [(i, plain(t)) for i, t in rows]
    found = roots((a, b) for a in range(len(fps)) for b in range(a, len(fps)) if (fps[a][1] ^ fps[b][1]).bit_count() <= 3)
    least = {}
    for k, r in found.items():
        i = fps[k][0]
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{f:016x}", least.get(found[k])) for k, (i, f) in enumerate(fps)), key=str)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_fingerprint_is_the_definition(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain(text)


def test_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op2_simhash(spark, SF).collect()), key=str)
    assert got == expected(rows)


def points(spark, n, seed, spread):
    """Fingerprints around a few centres, so that cells are full."""
    draw = random.Random(seed)
    centres = [draw.getrandbits(64) for _ in range(4)]
    out = set()
    for _ in range(n):
        x = draw.choice(centres)
        for _ in range(draw.randrange(spread)):
            x ^= 1 << draw.randrange(64)
        out.add(x)
    return sorted(out), spark.createDataFrame([(simhash._signed(x),) for x in out], "fp long")


def test_links_are_all_close_pairs_in_either_grid(spark):
    values, df = points(spark, 300, 1, 5)
    want = {
        tuple(sorted((simhash._signed(a), simhash._signed(b))))
        for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3
    }
    assert len(want) > 100
    for most in (2, 1_000):
        assert {tuple(r) for r in simhash.links(df, max_cell=most).collect()} == want


def test_manhattan_is_a_lower_bound(spark):
    values, df = points(spark, 60, 2, 20)
    c = df.select("fp", simhash.segment_counts(F.col("fp")).alias("c"))
    pairs = c.alias("a").join(c.alias("b"), F.col("a.fp") < F.col("b.fp")).select(
        F.col("a.fp"), F.col("b.fp"), simhash.manhattan(F.col("a.c"), F.col("b.c"))
    )

    def counts(x):
        return np.array([(x >> (2 * i) & 3).bit_count() for i in range(32)])

    for a, b, bound in pairs.collect():
        a, b = a % (1 << 64), b % (1 << 64)
        assert bound == abs(counts(a) - counts(b)).sum() <= (a ^ b).bit_count()


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = simhash.near_duplicates(odd)
    got = found.select("doc_id", simhash.hex_fingerprint("fp"), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    assert simhash.near_duplicates(none).collect() == []


def test_one_of_each_group_stays(odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "6", "7", "8", "None"]
    assert simhash.keep_one(none).collect() == []


def test_chains_and_stars(spark):
    draw = random.Random(3)
    chain = [(i, i + 1) for i in range(200)]
    star = [(500, 500 + i) for i in range(1, 150)]
    some = [(draw.randrange(1_000, 1_200), draw.randrange(1_000, 1_200)) for _ in range(150)]
    links = [e for e in chain + star + some if e[0] != e[1]]
    df = spark.createDataFrame(links + links[:5] + [(9_000, 9_000)], "u long, v long")
    assert {r.node: r.root for r in components(df).collect()} == roots(links)
    assert components(df.where("u < 0")).collect() == []
