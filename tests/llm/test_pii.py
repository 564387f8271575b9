"""Pseudonyms: formats, validity, a permutation, linked values, untouched rest."""

import datetime
import hashlib
import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F
from tarmac.llm import pii as P


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def feistel(kind, left, right, a, b, key=P.KEY):
    for i in range(P.ROUNDS):
        f = lambda x: int(hashlib.sha256(f"{key}|{kind}|{i}|{x}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        if i % 2 == 0:
            left = (left + f(right)) % a
        else:
            right = (right + f(left)) % b
    return left, right


def run(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, [tuple(v) for v in r["values"]]) for r in P.pseudonymise(df, **kw).orderBy("doc_id").collect()]


def test_card_ip_and_day_equal_a_plain_feistel(spark):
    (text, values), = run(spark, ["pay 4111 1111 1111 1111 from 10.0.0.1 on 2021-02-28."])
    left, right = feistel("card", 1111111, 1111111, 10**7, 10**7)
    body = "4" + f"{left:07d}{right:07d}"
    card = next(body + c for c in "0123456789" if luhn(body + c))
    left, right = feistel("ip", 10 * 256, 1, 65536, 65536)
    ip = str(ipaddress.ip_address(left << 16 | right))
    n = (datetime.date(2021, 2, 28) - datetime.date(1900, 1, 1)).days
    left, right = feistel("date", n // 4297, n % 4297, 17, 4297)
    day = datetime.date(1900, 1, 1) + datetime.timedelta(left * 4297 + right)
    card = " ".join(card[i:i + 4] for i in (0, 4, 8, 12))
    assert text == f"pay {card} from {ip} on {day}."
    assert values == [("card", card), ("ip", ip), ("date", str(day))]


@pytest.mark.parametrize("form", ["{}", "a {} b", "x:{},", "({})", "{}\n{}"])
def test_formats_stay_valid(spark, form):
    cases = {"date": ["1999-12-31", "2000/02/29", "29.02.2000", "12/31/1999", "31-12-1999"],
             "ssn": ["123-45-6789", "899-01-0001"], "phone": ["(212) 555-0187", "212-555-0187", "212.555.0187"],
             "ip": ["0.0.0.0", "255.255.255.255", "8.8.4.4"],
             "card": ["4111111111111111", "5500-0000-0000-0004", "3782 822463 10005"],
             "iban": ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"]}
    texts = [(k, v, form.format(v, v)) for k, vs in cases.items() for v in vs]
    for (kind, value, text), (new, found) in zip(texts, run(spark, [t for *_, t in texts])):
        assert [k for k, _ in found] == [kind] * form.count("{}"), (text, new, found)
        fake = found[0][1]
        assert {v for _, v in found} == {fake} and new == form.format(fake, fake)
        if kind != "ip":
            assert re.sub("[0-9]", "0", fake) == re.sub("[0-9]", "0", value)
        d = re.sub("[^0-9]", "", fake)
        if kind == "card":
            assert luhn(d) and d[0] == re.sub("[^0-9]", "", value)[0]
        if kind == "ip":
            ipaddress.ip_address(fake)
        if kind == "ssn":
            assert 0 < int(d[:3]) < 900 and d[:3] != "666" and d[3:5] != "00" and d[5:] != "0000"
        if kind == "phone":
            assert d[0] in "23456789" and d[3] in "23456789"
        if kind == "iban":
            c = fake.replace(" ", "")
            assert int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


def test_not_valid_stays(spark):
    for text in ["4111111111111112", "256.1.1.1", "000-12-3456", "666-12-3456", "2021-02-30", "2021-13-01", "(112) 555-0187",
                 "DE00370400440532013000", "1.2.3.4.5", "v2021-01-019", "a12345678901234567890b", "1800-01-01"]:
        assert run(spark, [text]) == [(text, [])], text


def test_dates_are_a_permutation(spark):
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(i) for i in range(P.DAYS)]
    df = spark.createDataFrame([(i, str(d)) for i, d in enumerate(days)], "doc_id long, text string")
    got = [r.text for r in P.pseudonymise(df).select("text").collect()]
    assert len(set(got)) == P.DAYS and set(got) == {str(d) for d in days}


def test_equal_values_stay_linked_and_keys_differ(spark):
    (_, a), (_, b), (_, c) = run(spark, ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"])
    assert len({re.sub("[^0-9]", "", v[0][1]) for v in (a, b, c)}) == 1
    assert run(spark, ["4111111111111111"], key="k2")[0][1] != c
    rnd = random.Random(2)
    ips = list({".".join(str(rnd.randrange(256)) for _ in range(4)) for _ in range(2000)})
    assert len({t for t, _ in run(spark, ips)}) == len(ips)


def test_no_python_in_the_plan(spark, documents):
    plan = P.pseudonymise(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_odd_rows(spark, odd, empty):
    got = P.pseudonymise(odd.withColumn("values", F.lit(1)))
    assert got.columns == [*odd.columns, "values"]
    assert sorted((r.text or "" for r in got.collect())) == sorted(r.text or "" for r in odd.collect())
    assert P.pseudonymise(empty).count() == 0
    with pytest.raises(ValueError):
        P.pseudonymise(odd, key="")


def test_the_rest_of_the_text_stays(documents):
    new = {r.doc_id: r for r in P.pseudonymise(documents).collect()}
    n = 0
    for r in documents.collect():
        text = new[r.doc_id].text
        for _, fake in new[r.doc_id]["values"]:
            assert fake in text
            n += 1
        mask = lambda t: re.sub(r"[0-9.]+", "#", t)
        assert mask(text) == mask(r.text)
    assert n
