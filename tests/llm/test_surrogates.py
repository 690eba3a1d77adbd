import re

import pytest
from pyspark.sql import functions as F

from cuesheet.llm import surrogates as P

SCHEMA = "doc_id bigint, text string, entity string, n_entities int"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


TEXTS = [
    "Write to Ann.Lee42@mail3.example.com, or call +1 (743) 555-3824 today.",
    "ann.lee42@mail3.example.com again; +1-743-555-3824 again; ANN.LEE42@MAIL3.EXAMPLE.COM",
    "card 4785380592391139 and 4785 3805 9239 1139, host 8.196.197.208, inner 192.168.7.9.",
    "Mrs. Smith met Mr Smith and Frau Müller; госпожа Иванова и г-н Иванов.",
    "no personal data, 12.5 or 1234 or a@b", None, "", "12345678901234567890123456789 x 1.2.3.4.5 3.1415926535897932384",
    "x" * 200_000 + " bob@example.org " + "@" * 1000 + "9" * 50_000,
]


@pytest.fixture(scope="module")
def replaced(spark):
    rows = [(i, t, "e", 0) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "e", 0), (None, TEXTS[0], "e", 0)]
    out = P.replace_personal_data(spark.createDataFrame(rows, SCHEMA), "k").collect()
    assert len(out) == len(rows)
    same = [r["text"] for r in out if r["doc_id"] in (0, None)]
    assert len(same) == 3 and len(set(same)) == 1
    return {r["doc_id"]: r for r in out if r["doc_id"] is not None}


def test_gaps_stay_and_mentions_go(replaced):
    for i, text in enumerate(TEXTS):
        new = replaced[i]["text"]
        if not replaced[i]["n_mentions"]:
            assert new == text
    assert [replaced[i]["n_mentions"] for i in range(9)] == [2, 3, 4, 5, 0, 0, 0, 0, 1]
    assert [replaced[i]["n_entities"] for i in range(4)] == [2, 2, 3, 5]
    assert re.fullmatch(r"Write to [a-z]{3}\.[a-z]{3}\d\d@[a-z]{4}\d\.[a-z]{7}\.com, or call \+1 \(\d{3}\) \d{3}-\d{4} today\.", replaced[0]["text"])
    for word in ("ann.lee", "743", "4785380592391139", "8.196.197.208", "Smith", "Müller", "Иванов"):
        assert all(word.lower() not in (replaced[i]["text"] or "").lower() for i in range(4))


def test_coreference_over_formats_and_documents(replaced):
    mail = re.search(r"\S+@\S+(?=,)", replaced[0]["text"])[0]
    again = replaced[1]["text"]
    assert again.startswith(mail) and again.endswith(mail.upper())
    phone = re.search(r"\+1 \((\d+)\) (\d+)-(\d+)", replaced[0]["text"])
    assert "+1-" + "-".join(phone.groups()) in again
    one, two = re.search(r"card (\d{16}) and ([\d ]{19})", replaced[2]["text"]).groups()
    assert one == two.replace(" ", "") and luhn("4785380592391139") == luhn(one) and one[0] == "4"


def test_types_keep_gender_script_and_format(replaced):
    assert re.search(r"inner 192\.168\.\d+\.\d+\.$", replaced[2]["text"])
    m = re.fullmatch(r"Mrs\. ([A-Z][a-z]+a) met Mr ([A-Z][a-z]+o) and Frau ([A-Z][a-z]+a); госпожа ([А-Я][а-я]+а) и г-н ([А-Я][а-я]+ов)\.", replaced[3]["text"])
    assert m and len(set(m.groups())) == 5


def test_surrogates_stay_distinct_when_draws_collide(spark):
    """Private addresses of one prefix: many entities for few places."""
    rows = [(f"ip:192.168.{i}.{j}",) for i in range(1, 60) for j in range(1, 150)]
    table = P.surrogate_table(spark.createDataFrame(rows, "entity string"), "k")
    got = {r["entity"]: r["surrogate"] for r in table.collect()}
    assert set(got) == {r[0] for r in rows} and len(set(got.values())) == len(rows) and not set(got.values()) & set(got)


def test_key_decides(spark):
    e = spark.createDataFrame([("email:a.b@c.de",)], "entity string")
    one, two, three = (e.select(P.draw(F.col("entity"), F.lit(0), k)).first()[0] for k in ("x", "x", "y"))
    assert one == two != three


def test_no_rows(spark):
    assert P.replace_personal_data(spark.createDataFrame([], SCHEMA)).count() == 0


def iban_valid(text):
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_national_forms_and_identifiers(spark):
    texts = ["call 555-123-4567 or (555) 123-4567 now", "ssn 123-45-6789.", "pay DE89 3704 0044 0532 0130 00 AND DE89370400440532013000 now",
             "host 2001:db8::1 is 2001:0DB8:0:0:0:0:0:1 and std::vector at 12:30", "Berlin 030 1234567"]
    rows = [(i, t, "", 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in P.replace_personal_data(spark.createDataFrame(rows, SCHEMA), "k").collect()}
    assert [got[i]["n_mentions"] for i in range(5)] == [2, 1, 2, 2, 1] and all(got[i]["n_entities"] == 1 for i in range(5))
    one = re.fullmatch(r"call (\d{3})-(\d{3})-(\d{4}) or \((\d{3})\) (\d{3})-(\d{4}) now", got[0]["text"]).groups()
    assert one[:3] == one[3:] != ("555", "123", "4567")
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4}\.", got[1]["text"]) and "123-45-6789" not in got[1]["text"]
    a, b = re.fullmatch(r"pay (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) AND (DE\d{20}) now", got[2]["text"]).groups()
    assert a.replace(" ", "") == b != "DE89370400440532013000" and iban_valid(a)
    x, y = re.fullmatch(r"host 2001:([0-9a-f]{3})::[1-9a-f] is 2001:0([0-9A-F]{3}):0:0:0:0:0:[1-9A-F] and std::vector at 12:30", got[3]["text"]).groups()
    assert x == y.lower() != "db8" and "1234567" not in got[4]["text"]


def test_shorter_mentions_get_parts_of_the_same_surrogate(spark):
    texts = ["Mr John Smith came. Mr Smith left, and Smith's dog barked at SMITH.", "Mrs Anna Maria Schmidt with Prof. Dr. Jane O'Hara The end",
             "Frau Dr. Weber; Dr Weber", "Smith alone"]
    rows = [(i, t, "", 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in P.replace_personal_data(spark.createDataFrame(rows, SCHEMA), "k").collect()}
    m = re.fullmatch(r"Mr ([A-Z][a-z]+o) ([A-Z][a-z]+o) came\. Mr (\w+) left, and (\w+)'s dog barked at ([A-Z]+)\.", got[0]["text"])
    assert m and m[2] == m[3] == m[4] == m[5].capitalize() and got[0]["n_entities"] == 1 and got[0]["n_mentions"] == 2
    assert re.fullmatch(r"Mrs [A-Z][a-z]+a [A-Z][a-z]+a [A-Z][a-z]+a with Prof\. Dr\. [A-Z][a-z]+e [A-Z][a-z]+e The end", got[1]["text"])
    assert not {"Anna", "Maria", "Schmidt", "Jane", "Hara"} & set(re.findall(r"\w+", got[1]["text"]))
    one, two = re.fullmatch(r"Frau Dr\. (\w+); Dr (\w+)", got[2]["text"]).groups()
    assert one == two != "Weber" and got[3]["text"] == "Smith alone"


def test_a_full_format_grows(spark):
    rows = [(f"email:{c}@x.de",) for c in "abcdefghijklmnopqrstuvwxyz"] + [(f"email:{c}@{d}.de",) for c in "abcdefghijklmnopqrstuvwxyz" for d in "abcdefghijklmnopqrstuvwyz"]
    got = {r["entity"]: r["surrogate"] for r in P.surrogate_table(spark.createDataFrame(rows, "entity string"), "k").collect()}
    assert set(got) == {r[0] for r in rows} and len(set(got.values())) == len(rows) and not set(got.values()) & set(got)
