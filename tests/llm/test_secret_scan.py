import hashlib
import math
import random
import re
import string
import uuid
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadflow.llm import queries, secret_scan
from leadflow.llm.secret_scan import KINDS, base_spans, infer, randomness

SF = "/root/testdata/sf0.001"


def plain(text):
    """The fixed patterns as the contract has them."""
    text = text or ""
    out = []
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in
                    ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(f"({word})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append((m.start(), "assign", m.end()))
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def test_query_equals_fixed_patterns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op7_secret_scan(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        want = plain(d.text)
        r = got[d.doc_id]
        said = ",".join(f"{k}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in want) for x in KINDS[:3]]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


pieces = st.sampled_from([
    "password", "PassWD", "ſecret", "secret", "toKen", "toKen", "api_key", "APIkey", "=", ":", " ", "  ", "'", '"', "abc",
    "abcdef12", "AKIA", "ABCDEFGHIJ", "0123456789abcdef", "\n", "🎈", "x.y/z+", "é",
])


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=14).map("".join))
def test_base_spans(text):
    assert [(a, k, b) for a, b, k in base_spans(text)] == plain(text)


def test_alphabets():
    assert infer("deadbeef0123") == "hex" and infer("DEADBEEF0123") == "HEX"
    assert infer("abcdefghij") is None and infer("1234567890") is None
    assert infer("GEZDGNBVGY3TQOJQ") == "base32" and infer("Zm9vYmFy+9/x==") == "base64"
    assert infer("Zm9v-_x1") == "base64url" and infer("a+b_c-1") is None


def test_random_tokens_pass_and_patterns_fail():
    draw = random.Random(1)
    tokens = ["".join(draw.choices("0123456789abcdef", k=40)) for _ in range(400)]
    passed = sum(randomness(t, "hex") >= 0.01 for t in tokens)
    assert passed >= 380
    words = ["internationalisation1", "alpha-beta-gamma-delta-1", "section_title_number_12"]
    assert all(randomness(t, infer(t)) < 0.001 for t in words[1:])
    for t in ("01" * 20, "0123456789abcdef" * 3, "a" * 39 + "1", "0000111122223333444455556666777788889999aaaa"):
        assert randomness(t, "hex") < 0.001


def corpus(n, seed):
    draw = random.Random(seed)
    words = ["alpha-beta-gamma-delta-1", "section_title_number_12", "aaaaaaaaaaaaaaaa1111", "2024-11-05-release-notes"]
    out = []
    for i in range(n):
        body = [draw.choice(["the", "of", "and", "report"]) for _ in range(20)] + [draw.choice(words)]
        if i % 10 == 0:
            body.append("".join(draw.choices(string.ascii_letters + string.digits + "+/", k=44)))
        draw.shuffle(body)
        out.append((i, " ".join(body), "en", "s"))
    return out


def test_discoveries_are_the_random_tokens(documents):
    got = {r.doc_id: [s for s in r.spans if s["kind"] == "random"] for r in secret_scan.scan(documents(corpus(400, 2))).collect()}
    hits = sum(bool(v) for k, v in got.items() if k % 10 == 0)
    wrong = sum(bool(v) for k, v in got.items() if k % 10)
    assert hits >= 28 and wrong <= 1


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def plain_fit(texts):
    """The battery from its definition: shares, nulls, places and thresholds over lists of texts."""
    symbols = Counter("".join(texts))
    shares, nulls = {}, {}
    for e, own in secret_scan.ENCODINGS.items():
        n = [symbols[c] + 1 for c in own]
        shares[e] = {c: math.log(sum(n) / k / len(own)) for c, k in zip(own, n)}
        mean = sum(k / sum(n) * shares[e][c] for c, k in zip(own, n))
        nulls[e] = mean, sum(k / sum(n) * (shares[e][c] - mean) ** 2 for c, k in zip(own, n))
    all_runs = [r for t in texts for r in re.findall("[A-Za-z0-9+/_=-]+", t)]
    words = [w for w in all_runs if 8 <= len(w) < 16 and re.fullmatch("[A-Za-z]+", w)]
    wider = 1.0
    if words:
        mean, variance = nulls["letters"]
        squares = [len(w) * (sum(shares["letters"][c] for c in w) / len(w) - mean) ** 2 for w in words]
        wider = max(1.0, sum(squares) / len(words) / variance)
    nulls = {e: (m, max(v * wider, 0.05)) for e, (m, v) in nulls.items()}

    def z(token, e):
        body = token.rstrip("=")
        return (sum(shares[e][c] for c in body) / len(body) - nulls[e][0]) / math.sqrt(nulls[e][1] / len(body))

    runs = sorted({r for r in all_runs if len(r) >= 16})
    tokens = [(t, e) for r in runs for _, _, t, e in secret_scan.candidates(r)]
    steps = {}
    for f in (0, 1):
        own = [(t, e) for t, e in tokens if t.isalpha() == bool(f)]
        plain_z = [z(t, e) for t, e in own if randomness(t, e) < 0.01]
        place = 0.0, 1.0
        if f == 0 and len(plain_z) >= 100:
            mean = sum(plain_z) / len(plain_z)
            place = mean, max(1.0, math.sqrt(sum(x * x for x in plain_z) / len(plain_z) - mean**2))
        length = sum(len(t) for t, _ in own) / len(own) if own else 1.0

        def step(t, e, place=place, length=length):
            if randomness(t, e) < 0.001:
                return 0
            p = tail((z(t, e) - place[0]) / place[1])
            return min(max(math.floor(-32 * math.log10(p / (len(t.rstrip("=")) / length))), 0), 9600) if p else 9600

        found = sorted((step(t, e) for t, e in own), reverse=True)
        passing = [s for i, s in enumerate(found) if s and 10 ** (-s / 32) <= 0.01 * sum(x >= s for x in found) / len(found)]
        steps[f] = step, min([*passing, math.ceil(32 * math.log10(max(len(own), 1) / 0.01))])
    return steps


def plain_spans(text, steps):
    base = [(a, b, k) for a, k, b in plain(text)]
    covered = {i for a, b, _ in base for i in range(a, b)}
    hits = set()
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text or ""):
        if len(m[0]) >= 16:
            for a, b, t, e in secret_scan.candidates(m[0]):
                step, least = steps[t.isalpha()]
                if step(t, e) >= least:
                    hits |= set(range(m.start() + a, m.start() + b))
    more = sorted(hits - covered)
    spans = list(base)
    for i in more:
        if spans and spans[-1][2] == "random" and spans[-1][1] == i:
            spans[-1] = spans[-1][0], i + 1, "random"
        else:
            spans.append((i, i + 1, "random"))
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def test_query_equals_brute_force(spark, tmp_path):
    """All columns of the query, on the test documents with random values added, against plain Python."""
    draw = random.Random(8)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(d.doc_id, (d.text or "") + f" {''.join(draw.choices(string.ascii_letters + string.digits, k=40))}" * (d.doc_id % 5 == 0)) for d in docs]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    steps = plain_fit([t for _, t in rows])
    got = {r.doc_id: r for r in queries.op7_secret_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and sum("random" in r.spans for r in got.values()) >= 0.9 * len(rows) / 5
    for i, text in rows:
        assert got[i].spans == plain_spans(text, steps), i


ALPHABETS = {
    "lower": string.ascii_lowercase, "UPPER": string.ascii_uppercase, "letters": string.ascii_letters,
    "base32": string.ascii_uppercase + "234567", "base36": string.ascii_lowercase + string.digits,
    "BASE36": string.ascii_uppercase + string.digits, "HEX": "0123456789ABCDEF",
    "base64": string.ascii_letters + string.digits + "+/", "base64url": string.ascii_letters + string.digits + "-_",
}


@pytest.fixture(scope="module")
def battery(spark):
    return secret_scan.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize("length", [32, 48])
@pytest.mark.parametrize("name", ALPHABETS)
def test_recall_of_random_values(battery, name, length):
    draw = random.Random(length)
    values = ["".join(draw.choices(ALPHABETS[name], k=length)) for _ in range(200)]
    found = [battery.spans(f"so it is {v} here") for v in values]
    whole = sum(sum(b - a for a, b, _ in spans) >= 0.9 * length for spans in found)
    assert whole >= 180


def test_recall_of_uuids(battery):
    draw = random.Random(2)
    values = [str(uuid.UUID(int=draw.getrandbits(128), version=4)) for _ in range(200)]
    assert sum(battery.spans(f"id {v}.") == [(3, 39, "random")] for v in values) >= 180


def test_false_alarms_in_texts_without_secrets(spark, battery):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    plain_texts = [t for t in texts if not plain(t)]
    alarmed = sum(bool(battery.spans(t)) for t in plain_texts)
    assert alarmed < 0.01 * len(plain_texts)


def test_words_and_short_tokens_are_no_secrets(battery):
    for text in (
        "quetion auxment treouvi rething tionaux", "internationalisation Geschwindigkeitsbegrenzung", "x9Zq7Kp2", "a1b2c3d4e5",
        "2024-11-05-release-notes alpha-beta-gamma-delta-1 section_title_number_12", "aaaaaaaaaaaaaaaa1111", "4417744280351547",
    ):
        assert battery.spans(text) == []


def test_step_up_rule_on_the_grid(documents):
    rows = corpus(300, 3)
    fitted = secret_scan.fit(documents(rows))
    tokens = {(t, e) for _, text, _, _ in rows for r in re.findall("[A-Za-z0-9+/_=-]{16,}", text) for _, _, t, e in secret_scan.candidates(r)}
    steps = [
        secret_scan.step_of(t, e, fitted.ordinary, fitted.lengths[0], 0.001) for t, e in tokens if not t.isalpha()
    ]
    p = sorted(10 ** (-s / secret_scan.GRID) for s in steps if s)
    k = max((i + 1 for i, x in enumerate(p) if x <= 0.01 * (i + 1) / len(steps)), default=0)
    assert k and sum(s >= fitted.steps[0] for s in steps) == k


def test_redaction(documents):
    secret = "0123456789abcdef0123456789abcdef"
    docs = documents([(1, f"x token={secret} y AKIA{'Z9' * 10}!", "en", "s"), (2, "clean", "en", "s"), (3, None, None, None)])
    got = secret_scan.redact(docs)
    assert got.columns == docs.columns
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[1].text == "x <secret> y <secret>!" and by_id[1].n_chars == len(by_id[1].text)
    assert by_id[2].text == "clean" and by_id[3].text is None and by_id[3].row == "x"


def test_odd_rows(odd, none):
    got = secret_scan.scan(odd).collect()
    assert len(got) == 11 and all(r.spans == [] for r in got if r.doc_id in (3, 4, 5))
    assert secret_scan.scan(none).collect() == []


def test_tokens_behind_names_and_of_any_make_are_tested(documents):
    draw = random.Random(6)
    symbols = string.ascii_letters + string.digits
    value = lambda n=60, of=symbols: "".join(draw.choices(of, k=n))
    key = "".join(draw.choices("ACDEFGHIJKLMNOPQRSTUVWXYZ", k=17))
    secrets = {
        1: ("sig=", value()), 2: ("auth=", value(of=symbols + "+/") + "=="), 3: ("http://a.b/c?key=", value()),
        4: ("a-b/", value()), 5: ("/old-path_name/", value()), 6: ("", value(90, string.ascii_letters)),
        7: (f"AKIA{key}/", value()),
    }
    rows = [(i, f"{secrets[i][0]}{secrets[i][1]} of" if i in secrets else t, "en", "s") for i, t, _, _ in corpus(400, 2)]
    got = {r.doc_id: r.spans for r in secret_scan.scan(documents(rows)).collect()}
    for i, (before, secret) in secrets.items():
        covered = {x for s in got[i] for x in range(s["start"], s["stop"])}
        assert set(range(len(before), len(before) + len(secret))) <= covered, i


def test_candidates():
    found = [(t, e) for *_, t, e in secret_scan.candidates(
        "k=x9Zq the a-b/c9 sig=Zm9vYmFyZm9vYmFyMQ== 123e4567-e89b-42d3-a456-426614174000 abcdefghijklmnopqrst 1234567890123456"
    )]
    assert found == [("Zm9vYmFyZm9vYmFyMQ==", "base64"), ("123e4567e89b42d3a456426614174000", "hex"), ("abcdefghijklmnopqrst", "lower")]
    assert [secret_scan.family(t) for t in ("x9Zq", "x" * 16)] == [0, 1]
