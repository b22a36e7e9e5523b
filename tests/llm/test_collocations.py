import re
from collections import Counter

import numpy as np
from compare import connect, difference
from hypothesis import given, settings
from hypothesis import strategies as st

from leadflow.llm import collocations, queries
from leadflow.llm.collocations import Automaton

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    assert difference(queries.op11_collocations(spark, SF), connect(SF), queries.OP11_SQL) is None


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, longest=3, least=10, share=50, top=2000):
    """The contract, phrase by phrase."""
    f = {}
    for lang, text in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for g, c in own.items() if len(g) == 1)
        candidates = {g: c for g, c in own.items() if len(g) > 1 and c >= least}
        found = []
        for g, a in candidates.items():
            cuts = [(10**6 * a * a // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g))]
            inside = [
                c for h, c in candidates.items()
                if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
            ]
            if not any(100 * c >= share * a for c in inside):
                score, _, left, right = min(cuts)
                found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


words = st.sampled_from(["a", "b", "B", "c", "É", "é", "the", "\x00", "x-y", "漢"])
texts = st.lists(words | st.sampled_from([".", ",", "\n", "  ", "\t", "?!"]), max_size=30).map(" ".join)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["en", None, "de"]), st.none() | texts), max_size=12))
def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(t, g) for g, t in rows], "text string, lang string").repartition(3)
    options = {"longest": 4, "least": 2, "share": 60, "top": 5}
    got = collocations.collocations(docs, **options, ranges=5).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, **options)


def grams(draw):
    return [
        (np.array(sorted({tuple(x) for x in draw.integers(0, 6, (9, k))}), np.int64).reshape(-1, k),) for k in (1, 2, 3)
    ]


def weighted(draw):
    return [(rows, draw.integers(1, 4, len(rows))) for rows, in grams(draw)]


def as_counts(automaton):
    return {
        tuple(automaton.words[i] for i in row): int(w)
        for rows, weights in automaton.grams(3) for row, w in zip(rows.tolist(), weights) if w
    }


def test_automata_hold_unite_and_look_up():
    draw = np.random.default_rng(4)
    words = [b"a", b"b", b"bb", b"c", "é".encode(), b"z"]
    held = []
    for _ in range(40):
        own = weighted(draw)
        automaton = collocations.only_used(words, own)
        want = {tuple(words[i] for i in row): int(w) for rows, ws in own for row, w in zip(rows.tolist(), ws)}
        assert as_counts(automaton) == want and as_counts(Automaton.load(automaton.dump())) == want
        held.append((automaton, want))
    for (a, x), (b, y) in zip(held, held[1:]):
        both = collocations.united([a, b], 3)
        total = Counter(x) + Counter(y)
        assert as_counts(both) == total
        asked = [list(g) for g in total] + [[b"a", b"nowhere"], [b"z"] * 4, [b"q"]]
        assert both.compose(asked) == [total.get(tuple(g), 0) for g in asked]
        assert as_counts(collocations.united([a, b], 3, 4)) == {g: c for g, c in total.items() if c >= 4}


def test_automata_are_minimal():
    rows = [np.array([[0], [1]]), np.array([[0, 2], [1, 2]]), np.array([[0, 2, 3], [1, 2, 3]])]
    automaton = Automaton.build([b"a", b"b", b"c", b"d"], [(r, np.ones(len(r), np.int64)) for r in rows])
    assert len(automaton.start) == 5 and len(automaton.label) == 4  # one path behind both first words
    assert collocations.united([], 2).compose([[b"a"]]) == [0] and collocations.united([], 2).compose([]) == []


def test_wide_numbers_sort_as_narrow_ones():
    rows = np.random.default_rng(1).integers(0, 50, (500, 3))
    for n in (50, 1 << 30):
        order, first = collocations._order(rows, n)
        assert (rows[order][first] == np.unique(rows, axis=0)).all()


def test_slices_and_shards_change_nothing(spark, monkeypatch):
    text = " ".join(["alpha beta gamma. delta, eps"] * 40)
    want = [w for part in collocations.words_of(text) for w in part]
    monkeypatch.setattr(collocations, "SLICE", 7)
    assert [w for part in collocations.words_of(text) for w in part] == want
    shard = collocations.Shard(3)
    for _ in range(3):
        shard.add("en", text)
    parts = [Automaton.load(x) for *_, x in shard.automata(4)]
    found = as_counts(collocations.united(parts, 3))
    assert found[b"alpha", b"beta", b"gamma"] == 120 and found[b"eps", b"alpha"] == 117 and shard.held == 0


def test_odd_rows(odd, none):
    rows = [(r.lang, r.text) for r in odd.collect()]
    got = collocations.collocations(odd, least=2).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, least=2)
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(odd).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
