"""Surrogates: kind, format, gender, script, distinctness and coreference."""

import re

from brightweir.llm import pii

from .helpers import docs_of, rows

KEY = "test key"
TEXTS = [
    "Call Mr. John Smith at +1 (017) 555-7713 or 017-555-7713; john.SMITH@mail7.example.com. Mr. Smith and MR. SMITH, Mrs. Anna Smith.",
    "card 4111 1111 1111 1111 / 4111-1111-1111-1111 / 4111111111111112 ip 10.200.3.44, 123-45-6789",
    "г-жа Анна Иванова и г-н Иванов, Dr. Kim",
    None,
    "",
    'JOHN.SMITH@MAIL7.EXAMPLE.COM!! token = "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e" DE89 3704 0044 0532 0130 00',
    "nothing here: version 4.0, 12.5 %, 2024-01-01, a@b, Mr nobody",
]


def replaced(spark, *texts, key=KEY):
    out = pii.replace(docs_of(spark, *texts), key)
    return {r["doc_id"]: r for r in out.collect()}


def luhn(number):
    digits = [int(d) for d in number[::-1] if d.isdigit()]
    return sum(digits[::2] + [sum(divmod(2 * d, 10)) for d in digits[1::2]]) % 10


def test_formats_and_coreference(spark):
    got = replaced(spark, *TEXTS)
    assert [got[i]["pii_entities"] for i in range(7)] == [7, 5, 3, 0, 0, 3, 0]
    assert [got[i]["text"] for i in (3, 4, 6)] == [TEXTS[i] for i in (3, 4, 6)]
    m = re.fullmatch(r"Call Mr. (\w+) (\w+) at \+1 (\(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4}); (\S+@\S+\.com). Mr. (\w+) and MR. (\w+), Mrs. (\w+) (\w+).", got[0]["text"])
    given, surname, _, _, mail, again, loud, her, hers = m.groups()
    assert given in pii.GIVEN["latin", "m"] and her in pii.GIVEN["latin", "f"]
    assert surname == again == hers == loud.capitalize() != "Smith"
    assert got[5]["text"].startswith(mail.upper() + "!!")
    cards = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}) / (\d{4}-\d{4}-\d{4}-\d{4}) / (\d{16}) ip (\d{2}\.\d{3}\.\d\.\d{2}), \d{3}-\d{2}-\d{4}", got[1]["text"]).groups()
    assert cards[0].replace(" ", "") == cards[1].replace("-", "") and luhn(cards[0]) == 0 != luhn("4111111111111112")
    assert all(int(octet) < 256 for octet in cards[3].split("."))
    she, family, his, plain = re.fullmatch(r"г-жа (\w+) (\w+) и г-н (\w+), Dr. (\w+)", got[2]["text"]).groups()
    assert she in pii.GIVEN["cyrillic", "f"] and re.fullmatch("[А-Я][а-я]+", family) and len(his) == len("Иванов") and plain != "Kim"
    assert re.search(r'"[0-9a-f]{40}"', got[5]["text"])


def test_keys_matter_and_runs_repeat(spark):
    one, two, other = (replaced(spark, TEXTS[0], key=k)[0]["text"] for k in (KEY, KEY, "another"))
    assert one == two != other


def test_distinct_values_stay_distinct_and_new(spark):
    """One-digit octets leave 6,561 addresses: many draws collide and are drawn again."""
    values = [f"{a}.{b}.{c}.{d}" for a in range(1, 9) for b in range(1, 9) for c in range(1, 9) for d in (1, 2, 3)]
    entities = spark.createDataFrame([("ip", v) for v in values], "kind string, canon string")
    got = pii.surrogates_of(entities, KEY).collect()
    new = [r["value"] for r in got]
    assert len(new) == len(set(new)) == len(values) and not set(new) & set(values)


def test_used_up_formats_are_relaxed(spark):
    names = [(f"given_{g}", chr(97 + i // 26) + chr(97 + i % 26)) for g in "fmu" for i in range(60)]
    got = pii.surrogates_of(spark.createDataFrame([*names, *(("surname", chr(97 + i)) for i in range(26))], "kind string, canon string"), KEY)
    per = [(r["kind"], r["value"]) for r in got.collect()]
    assert len(per) == len(set(per)) == 206
    assert not {v for k, v in per if k == "surname"} & {chr(97 + i) for i in range(26)}


def test_repeated_rows_long_texts_and_no_rows(spark):
    docs = docs_of(spark, "a@b.co", "word " * 200_000 + "x@y.org", "1" * 100_000)
    again = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 0").selectExpr("CAST(NULL AS BIGINT) AS doc_id", *docs.columns[1:]))
    out = pii.replace(again, KEY)
    assert out.columns == [*docs.columns, "pii_entities"]
    got = rows(out.select("doc_id", "pii_entities", "text"))
    same = {r[2] for r in got if r[0] in (0, None)}
    assert len(got) == 5 and len(same) == 1 and "a@b.co" not in same
    assert [r[1] for r in got if r[0] in (1, 2)] == [1, 0]
    assert pii.replace(docs.where("false"), KEY).count() == 0
