import bisect
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leadflow.llm import queries, substring_dedup
from leadflow.llm.substring_dedup import GEAR, LEAST, LOWEST_BIT, MASK_BITS, MOST, REACH, cuts, repeats, rolling

SF = "/root/testdata/sf0.001"


def plain_hashes(raw):
    h, out = 0, []
    for b in raw:
        h = (2 * h + int(GEAR[b])) % (1 << 64)
        out.append(h)
    return out


def plain_cuts(raw):
    hashes, out, at = plain_hashes(raw), [], 0
    first = lambda i: i == len(raw) or raw[i] & 0xC0 != 0x80
    wanted = [i + 1 for i, h in enumerate(hashes) if first(i + 1) and not h >> LOWEST_BIT & (1 << MASK_BITS) - 1]
    while at < len(raw):
        place = bisect.bisect_left(wanted, at + LEAST)
        stop = wanted[place] if place < len(wanted) else len(raw)
        if stop - at > MOST:
            stop = at + MOST
            while not first(stop):
                stop -= 1
        out.append(stop)
        at = stop
    return out


def brute(rows):
    """Passages by a table of all chunks."""
    texts = [(i, (t or "").encode()) for i, t in rows if i is not None]
    held, places = {}, {}
    for i, raw in texts:
        at = 0
        for stop in plain_cuts(raw):
            piece = raw[at:stop]
            held.setdefault(piece, set()).add(i)
            places.setdefault(i, set()).add((len(raw[:at].decode()), len(raw[:stop].decode()), piece))
            at = stop
    out = set()
    for i, own in places.items():
        run = []
        for a, b, piece in [*sorted(own), (None, None, None)]:
            shared = piece is not None and len(held[piece]) > 1
            if run and not (shared and a == run[-1][1]):
                if run[-1][1] - run[0][0] >= REACH:
                    out.add((i, run[0][0], run[-1][1], len(run), min(min(held[p]) for *_, p in run),
                             max(len(held[p]) for *_, p in run), all(min(held[p]) < i for *_, p in run)))
                run = []
            if shared:
                run.append((a, b, piece))
    return out


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300))
def test_hash_is_the_rolling_one(raw):
    assert rolling(np.frombuffer(raw, np.uint8)).tolist() == plain_hashes(raw)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab é漢🎈", max_size=900))
def test_cuts(text):
    raw = text.encode()
    assert cuts(np.frombuffer(raw, np.uint8)) == plain_cuts(raw)


def test_long_runs_of_one_character():
    for c in "aé🎈":
        raw = (c * 3_000).encode()
        got = cuts(np.frombuffer(raw, np.uint8))
        assert got == plain_cuts(raw) and got[-1] == len(raw)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in queries.op8_substring_dedup(spark, SF).collect()} == brute(rows)


def words(draw, n):
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randrange(2, 9))) for _ in range(n))


def test_planted_passages_are_found_whatever_stands_before(documents):
    draw = random.Random(4)
    planted = [words(draw, 51) for _ in range(40)]
    rows, where = [], {}
    for i in range(120):
        p = draw.randrange(40) if i % 2 else None
        before, after = words(draw, draw.randrange(80)), words(draw, draw.randrange(80))
        rows.append((i, before + "\n" + (planted[p] if p is not None else words(draw, 51)) + " " + after, "en", "s"))
        if p is not None:
            where.setdefault(p, set()).add(i)
    want = {i for own in where.values() if len(own) > 1 for i in own}
    got = repeats(documents(rows)).collect()
    assert {r.doc_id for r in got} == want
    kept = {r.doc_id: r.text for r in substring_dedup.drop_repeats(documents(rows)).collect()}
    assert len(kept) == 120
    for own in where.values():
        for i in sorted(own)[1:]:
            assert len(kept[i]) < len(rows[i][1]) - 100
    assert all(kept[i] == rows[i][1] for i in range(0, 120, 2))


def test_recall_of_passages_of_51_words(documents):
    """Prose of the test tables, planted twice in other texts."""
    import duckdb

    draw = random.Random(6)
    found = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where len(text) > 1500 order by doc_id").fetchall()
    prose = [t.split(" ") for t, in found]
    rows, want = [], []
    for i in range(150):
        own = draw.choice(prose)
        at = draw.randrange(max(len(own) - 51, 1))
        passage = " ".join(own[at : at + 51])
        for doc_id in (2 * i, 2 * i + 1):
            rows.append((doc_id, f"{words(draw, draw.randrange(5, 60))} {passage} {words(draw, draw.randrange(5, 60))}", "en", "s"))
        want.append(2 * i)
    got = {r.doc_id for r in repeats(documents(rows)).collect()}
    assert sum(i in got for i in want) >= 0.95 * len(want)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {tuple(r) for r in repeats(odd).collect()} == brute(rows)
    assert repeats(none).collect() == []
    assert substring_dedup.drop_repeats(odd).count() == 11
