import re
from collections import Counter, defaultdict

import numpy as np
from compare import connect, difference
from hypothesis import given, settings
from hypothesis import strategies as st

from leadflow.llm import divergence, queries

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    assert difference(queries.op13_divergence(spark, SF), connect(SF), queries.OP13_SQL) is None


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least_docs=3, top=200):
    """The contract, term by term."""
    n, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        n[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g for g, _ in n}:
        kept = [t for t, c in docs[lang].items() if c >= least_docs]
        groups = {s: n[lang, s] for g, s in n if g == lang}

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        whole = shares(sum(groups.values(), Counter()))
        for s, own in p.items():
            pairs = [(sum((own[t] - q[t]) ** 2 // q[t] for t in kept), o) for o, q in p.items() if o != s]
            more = [
                ((own[t] - whole[t]) ** 2 // whole[t], t) for t in kept if groups[s][t] and own[t] > whole[t]
            ]
            for part, found, most in (("pair", pairs, None), ("term", more, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, r) for r, (v, i) in enumerate(found[:most], 1)]
    return sorted(out)


texts = st.lists(st.sampled_from(["a", "b", "B", "c", "é", "É", "the", "12", "_", "x-y", "漢", "a.b"]), max_size=25).map(" ".join)
ROW = st.tuples(st.sampled_from(["en", None, "", "de"]), st.sampled_from(["s0", "s1", None, "s2"]), st.none() | texts)


@settings(max_examples=8, deadline=None)
@given(st.lists(ROW, max_size=14))
def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    got = divergence.divergence(docs, least_docs=2, top=3).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 2, 3)


def test_many_buckets_and_levels(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BUCKET", 20)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "SLICE", 16)
    draw = np.random.default_rng(3)
    names = ["".join("abcdefghij"[int(d)] for d in str(i)) for i in range(300)]
    rows = [
        ("en" if i % 9 else "de", f"s{i % 4}", " ".join(names[k] for k in draw.zipf(1.3, 60) % 300)) for i in range(90)
    ]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    assert sorted(tuple(r) for r in divergence.divergence(docs).collect()) == brute(rows)


def test_cells_are_those_of_the_joint_table():
    """Cells of two positive counts, from bitmaps, against a count of the terms."""
    import pyarrow as pa

    draw = np.random.default_rng(5)
    counts = draw.integers(0, 4, (3, 64))
    rows = []
    for g in range(3):
        for level in (1, 2, 3):
            bits = sum(1 << int(t) for t in np.flatnonzero(counts[g] == level))
            if bits:
                rows.append(("en", 0, 0, f"s{g}", 100 * level + g, 50 + g, np.uint64(bits).astype(np.int64)))
    table = pa.table(dict(zip(("lang", "bucket", "place", "source", "p", "p0", "bits"), map(list, zip(*rows)))))
    got = {(r["source"], r["other"]): r["cells"] for r in divergence._joint(table).to_pylist()}
    for g in range(3):
        for h in range(3):
            if g != h:
                want = sum(
                    (lambda p, q, p0, q0: (p - q) ** 2 // q - (p - q0) ** 2 // q0 - (p0 - q) ** 2 // q + (p0 - q0) ** 2 // q0)(
                        100 * int(a) + g, 100 * int(b) + h, 50 + g, 50 + h
                    )
                    for a, b in zip(counts[g], counts[h]) if a and b
                )
                assert got[f"s{g}", f"s{h}"] == want


def test_odd_rows(odd, none):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in divergence.divergence(odd, least_docs=1).collect()) == brute(rows, 1)
    assert sorted(tuple(r) for r in divergence.divergence(odd).collect()) == brute(rows)
    assert divergence.divergence(none).collect() == []
