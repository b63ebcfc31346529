"""Surrogates of one corpus differ; detectors find what they should; faults of the check are raised."""

import random

import pytest

from ratecraft.llm import pii


@pytest.mark.parametrize("alphabet,most", [("aeioubcdfgklmnrst", 20_000), ("аеиовнстк", 5_000), ("aéüoçnłš", 3_000)])
def test_names_never_share_a_surrogate(alphabet, most):
    rng, s = random.Random(3), pii.Surrogates("public example key")
    words = {w for names in pii.GIVEN.values() for w in names}
    while len(words) < most:
        words.add("".join(rng.choice(alphabet) for _ in range(rng.randint(3, 7))).capitalize())
    made = {w: s.of("name", w) for w in words}
    assert len(set(made.values())) == len(words)
    assert sum(a == b for a, b in made.items()) <= len(words) / 1000


def test_numbers_and_accounts_never_share_a_surrogate():
    rng, s = random.Random(4), pii.Surrogates("k")
    own = {"".join(rng.choice("0123456789") for _ in range(13)) for _ in range(20_000)}
    assert len({s.number(n) for n in own}) == len(own)
    ibans = set()
    for _ in range(3000):
        body = "".join(rng.choice("0123456789") for _ in range(13))
        check = 98 - int("".join(str(int(c, 36)) for c in body + "XX") + "00") % 97
        ibans.add(f"XX{check:02d}{body}")
    made = {s.iban(v) for v in ibans}
    assert all(map(pii._valid_iban, ibans | made)) and len(made) == len(ibans) and all(v[:2] == "XX" and len(v) == 17 for v in made)


@pytest.mark.parametrize("text,kinds", [
    ("I met Priya Raghavan and Zoë Müller there", ["name", "name"]), ("我叫王小明。", ["name"]), ("请李雷先生来", ["name"]), ("Dr. O'Brien said", ["name"]), ("call 555-4270 now", ["phone"]), ("06 12 34 56 78", ["phone"]),
    ("IBAN DE89370400440532013000 ok", ["iban"]), ("DE89 3704 0044 0532 0130 00", ["iban"]), ("host 2001:db8::1 up", ["ip6"]), ("at 12:30:45 we", []), ("My name is Kwame Nkrumah-Smith.", ["name"]),
    ("Lena Łukasz <lena@x.org>", ["name", "email"]), ("Mr. Åke Šimić", ["name"]), ("std::vector<int> x; a::b9", []), ("New York and Los Angeles", []), ("DE89370400440532013001", []), ("", []),
])
def test_what_is_found(text, kinds):
    found = sorted(pii.find(text))
    assert [k for _, _, k in found] == kinds
    new, spans = pii.replace_text(text, pii.Surrogates("k"))
    assert (new == text) == (not kinds) and all(a < b for _, a, b, _ in spans)


def test_surrogates_keep_their_kind():
    s = pii.Surrogates("k")
    assert pii._valid_iban(s.of("iban", "DE89 3704 0044 0532 0130 00")) and s.of("iban", "DE89 3704 0044 0532 0130 00")[:2] == "DE"
    assert s.of("name", "Елена Иванова").endswith("ова") and s.of("name", "Зоя Иванов").endswith("ов")
    assert s.of("name", "Kessandra").endswith("a") and len(s.of("name", "王小明")) == 3 and s.of("name", "王小明")[0] in pii.HAN_FAMILY
    # Coreference: a part of a name, and the same name in capitals, go along.
    full = s.of("name", "Kwame Nkrumah")
    assert full.split() == [s.of("name", "Kwame"), s.of("name", "Nkrumah")] and s.of("name", "KWAME").lower() == s.of("name", "Kwame").lower()


def test_the_corpus_is_checked(spark, monkeypatch):
    rows = [(1, "Mr. Karl Meier 4111 1111 1111 1111", "x"), (2, "Mrs. Anna Meier ann@a.com", None), (2, None, "y"), (3, "", "z"), (4, "Mr. Karl Meier again " * 500, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, entities string")
    got = {(r.doc_id, r.text): r.n_entities for r in pii.replace_checked(df, "k").collect()}
    assert sorted(got.values()) == [0, 0, 2, 2, 500] and pii.replace_checked(df, "k").columns == ["doc_id", "text", "n_entities"]
    assert pii.replace_checked(df.limit(0), "k").count() == 0
    assert pii._split(pii.replace(df, "k")).count() == pii._shared(pii.replace(df, "k")).count() == 0
    made = pii.replace(df, "k")
    from pyspark.sql import functions as F

    same = made.withColumn("entities", F.transform("entities", lambda e: e.withField("surrogate", F.lit("one")).withField("kind", F.lit("name"))))
    assert pii._shared(same).count() == 1
    monkeypatch.setattr(pii, "replace", lambda *a, **k: same)
    with pytest.raises(ValueError, match="a surrogate for two entities"):
        pii.replace_checked(df, "k")
