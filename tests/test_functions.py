import gzip
import io
from contextlib import redirect_stdout

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadflow.functions import names
from leadflow.functions.crypto import decrypt_lines, encrypt_lines
from leadflow.functions.insights import reshape_insight
from leadflow.functions.rules import polarity, priority, strength, tier
from leadflow.schemas import INSIGHT_IDS, insight_table, table_schema

KEYS = ["AAECAwQFBgcICQoLDA0ODw==", "EBESExQVFhcYGRobHB0eHw=="]


def test_id_lists(rows):
    df = rows([("3,1,,3,2",), (",,",), ("3,1x",), ("1,01",), ("",)], "s string")
    assert [r[0] for r in df.select(names.id_list(F.col("s"))).collect()] == [
        [3, 1, 2], [], None, [1, 1], [],
    ]


def test_file_order(rows):
    files = ["cdc-x", "cdc-10", "plain", "cdc-2", "a-b-3"]
    df = rows([(f,) for f in files], "name string").orderBy(*names.file_order(F.col("name")))
    assert [r.name for r in df.collect()] == ["cdc-2", "a-b-3", "cdc-10", "cdc-x", "plain"]


def test_name_parts(spark):
    found = spark.range(1).select(
        names.export_name(F.lit("t"), F.lit("c"), F.lit("f.gz")),
        names.export_client(F.lit("t-c-f.gz")),
        names.last_part(F.lit("p:d.t")),
        names.strip_prefix(F.lit("ab"), "a"),
        names.strip_prefix(F.lit("ba"), "a"),
        names.relative_name(F.lit("in/x"), "in"),
        names.relative_name(F.lit("in/"), "in"),
        names.pseudonym(F.lit(1)),
    ).first()
    assert tuple(found)[:7] == ("t-c-f.gz", "c", "t", "b", "ba", "x", None)
    assert found[7].startswith("6b86b273")


def test_match_score_truncates(rows):
    df = rows(
        [("e1", '{"entity_id":"e1","corex":83.9,"acme":-1.9}'), ("e2", '{"entity_id":"e2"}')],
        "entity_id string, body string",
    )
    scores = [r.scores for r in reshape_insight(df, "match-score").collect()]
    assert [tuple(s) for s in scores[0]] == [("corex", 83), ("acme", -1)] and scores[1] == []


def test_adopt_curve_keeps_fractions(rows):
    df = rows([("e1", '{"entity_id":"e1","news":0.25}')], "entity_id string, body string")
    scores = reshape_insight(df, "adopt-curve").first().scores
    assert [tuple(s) for s in scores] == [("news", 0.25)]


@pytest.mark.parametrize("insight_id", INSIGHT_IDS)
def test_every_insight_fits_its_table(rows, insight_id):
    body = '{"entity_id":"e1","preferences":["Email"],"persuasion":["Praise"],"prediction":"good","archetype":"x"}'
    if insight_id in ("match-score", "adopt-curve"):
        body = '{"entity_id":"e1","acme":1.5}'
    made = reshape_insight(rows([("e1", body)], "entity_id string, body string"), insight_id)
    schema = table_schema(insight_table(insight_id))
    simple = lambda fields: [f.dataType.simpleString() for f in fields]
    assert simple(made.schema) == simple(schema)[: len(made.columns)]
    assert made.to(schema).first()[1] is not None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from("0123,x"), max_size=12), min_size=1, max_size=20))
def test_any_id_list(spark, texts):
    def wanted(text):
        if set(text) - set("0123456789,"):
            return None
        return [int(p) for p in dict.fromkeys(text.split(",")) if p]

    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r[0] for r in df.select(names.id_list(F.col("s"))).collect()] == list(map(wanted, texts))


def test_crypto_roundtrip_with_a_wrong_key_first(rows):
    texts = [(i, f'{{"n":{i},"s":"é\\n"}}' * (i % 7)) for i in range(300)]
    sealed = encrypt_lines(rows(texts, "i int, text string"), KEYS, "text", use=1)
    lines = sealed.select("value").collect()
    assert all(len(r.value.split(":")[0]) == 32 and r.value == r.value.lower() for r in lines)
    assert len({r.value[:32] for r in lines}) == 300
    plain = decrypt_lines(sealed, KEYS).select("i", "text")
    assert sorted(map(tuple, plain.collect())) == sorted(texts)


def test_a_line_stays_the_same_in_all_its_uses(rows):
    sealed = encrypt_lines(rows([("x",)] * 20, "text string"), KEYS, "text")
    used = sealed.select("value", F.concat("value", F.lit("")).alias("again"), F.col("value").alias("v"))
    assert used.filter("value = again and value = v and length(again) = length(v)").count() == 20
    both = decrypt_lines(decrypt_lines(sealed, KEYS), KEYS, "value", "t2")
    assert all(r.text == r.t2 == "x" for r in both.collect())


def test_unreadable_lines_give_null(rows):
    good = encrypt_lines(rows([("x",)], "text string"), KEYS, "text").first().value
    damaged = good[:-2] + ("00" if good[-2:] != "00" else "11")
    df = rows([(damaged,), (good.replace(":", ""),), ("",), (None,), ("zz:00",)], "value string")
    assert [r.text for r in decrypt_lines(df, KEYS).collect()] == [None] * 5
    other = decrypt_lines(rows([(good,)], "value string"), KEYS[1:])
    assert other.first().text is None


def test_line_is_gzip_inside(rows, spark):
    value = encrypt_lines(rows([("hello",)], "text string"), KEYS, "text").first().value
    data = spark.sql(
        "select aes_decrypt(unhex(replace(:v, ':', '')), unbase64(:k), 'CBC', 'PKCS') d",
        args={"v": value, "k": KEYS[0]},
    ).first().d
    assert gzip.decompress(bytes(data)) == b"hello"


def test_keys_are_in_no_plan(rows):
    df = decrypt_lines(rows([("00:00",)], "value string"), KEYS)
    df.collect()
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(True)
    plan = out.getvalue().lower()
    for key in KEYS:
        import base64

        raw = base64.b64decode(key)
        assert raw.hex() not in plan and key.lower() not in plan
        assert str(list(raw))[1:-1] not in plan


@pytest.mark.parametrize("score, mood, label", [
    (0.83, 0.75, "High Priority Lead"),
    (0.90, -0.60, "Review Manually Before Sales"),
    (0.35, 0.80, "Consider for Nurturing"),
    (0.35, 0.10, "Low Priority"),
    (0.90, None, "High Priority Lead"),
    (None, 0.9, "Unscored"),
])
def test_priority(rows, score, mood, label):
    df = rows([(score, mood)], "score double, mood double")
    assert df.select(priority(F.col("score"), F.col("mood"))).first()[0] == label


def test_tier_and_polarity(rows):
    df = rows([(0.7,), (0.4,), (0.39,), (-0.26,), (0.25,), (0.26,), (None,)], "s double")
    found = df.select(tier(F.col("s")), polarity(F.col("s")), strength(F.col("s"))).collect()
    assert [r[0] for r in found] == ["hot", "warm", "cold", "cold", "cold", "cold", None]
    assert [r[1] for r in found] == [
        "Positive", "Positive", "Positive", "Negative", "Neutral", "Positive", None,
    ]
    assert found[3][2] == 0.26
