"""Pseudonyms against a plain Python version of the same network."""

import hashlib
import re
from datetime import date, timedelta

import pytest

from fathomline.llm import pii as P

KEY = "test key"


def network(left, right, sizes, tweak):
    for i in range(P.ROUNDS):
        other = right if i % 2 == 0 else left
        f = int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{other}".encode()).hexdigest()[:14], 16)
        if i % 2 == 0:
            left = (left + f) % sizes[0]
        else:
            right = (right + f) % sizes[1]
    return left, right


def digits(s, tweak):
    a = len(s) // 2
    b = len(s) - a
    x, y = network(int(s[:a]), int(s[a:]), (10**a, 10**b), tweak)
    return f"{x:0{a}d}{y:0{b}d}"


def luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s)))


def fill(shape, s):
    it = iter(s)
    return re.sub("[0-9]", lambda _: next(it), shape)


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def brute(value):
    bare = re.sub("[^0-9]", "", value)
    if "@" in value:
        return "user-" + hashlib.sha256(f"{KEY}|email|{value.lower()}".encode()).hexdigest()[:16] + "@example.invalid"
    if re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]+", value):
        rest = value[4:]
        new = fill(rest, digits(re.sub("[^0-9]", "", rest), "iban" + value[:2] + re.sub("[0-9]", "0", rest)))
        return f"{value[:2]}{98 - mod97(value[:2] + '00' + new):02d}{new}"
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", value):
        day = date(*map(int, m.groups()))
        cycle = (day.year - 1800) // 400
        first, (a, b) = {-5: (date(1, 1, 1), (13, 5591)), 20: (date(9800, 1, 1), (184, 397))}.get(cycle, (date(max(1, 1800 + 400 * cycle), 1, 1), (189, 773)))
        days = (day - first).days
        x, y = network(days // b, days % b, (a, b), f"date:{cycle}" if cycle else "date")
        return (first + timedelta(days=x * b + y)).isoformat()
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", value):
        area, group, serial = map(int, value.split("-"))
        x, y = network(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, (898, 99 * 9999), "ssn")
        return f"{x + (2 if x >= 665 else 1):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"
    if re.fullmatch(r"\d+(\.\d+){3}", value):
        o = list(map(int, value.split(".")))
        x, y = network(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), "ip")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if value[0] == "+" or "(" in value or re.fullmatch(r"\d{3}[-.]\d{3}[-.]\d{4}", value):
        return fill(value, bare[:-10] + digits(bare[-10:], "phone"))
    inner = bare[0] + digits(bare[1:-1], f"card{bare[0]}{len(bare)}")
    return fill(value, inner + str(-luhn(inner + "0") % 10))


VALUES = ["that.92@mail2.example.com", "4111 1111 1111 1111", "4337166598464399", "378282246310005", "5500-0000-0000-0004", "+1 (988) 555-2485", "(499) 555-6503", "415-555-0199", "+44 20 7946 0958", "+1 (068) 555-2748", "+49 30 123456", "42.144.35.254", "0.0.0.0", "255.255.255.255", "2024-02-29", "1800-01-01", "2199-12-31", "1750-03-04", "2250-01-01", "2200-01-01", "0001-01-01", "0199-12-31", "0200-01-01", "9799-12-31", "9800-01-01", "9999-12-31", "name@" + "sub." * 40 + "example.com", "078-05-1120", "899-99-9999", "667-01-0001", "DE89370400440532013000", "GB82WEST12345698765432"]
LEFT = ["4111 1111 1111 1112", "256.1.1.1", "1.2.3", "2023-02-29", "0000-01-01", "666-01-0001", "900-01-0001", "123-00-1234", "DE89370400440532013001", "12345", "0000000000000000", "a@b", "1.2.3.4.5", "v1.02.3.4"]


def run(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["text"] for r in P.pseudonymise(docs, KEY).orderBy("doc_id").collect()]


def test_values_match_brute_force(spark):
    got = run(spark, [f"é {v} and {v}, x" for v in VALUES])
    for value, text in zip(VALUES, got, strict=True):
        assert text == f"é {brute(value)} and {brute(value)}, x"
        assert brute(value) != value


def test_formats_stay_valid():
    for value in VALUES:
        new = brute(value)
        if "@" not in value:
            assert re.sub("[0-9]+", "0", new) == re.sub("[0-9]+", "0", value)
    assert all(luhn(re.sub("[^0-9]", "", brute(v))) % 10 == 0 for v in VALUES[1:5])
    assert mod97(brute("DE89370400440532013000")) == 1


def test_what_does_not_validate_is_left(spark):
    texts = [f"x {v} y" for v in LEFT]
    assert run(spark, texts) == texts


def test_neighbours_do_not_hide_values(spark):
    card, ip, phone = "4337166598464399", "42.144.35.254", "+1 (988) 555-2485"
    texts = [f"{card} 12 x", f"x.{ip}.", f"{phone} {card}", f"{card} {card}", f"{ip}%%% {ip} 4041", f"a@b.org### {phone}&&&"]
    got = run(spark, texts)
    for old, new in zip(texts, got, strict=True):
        for value in (card, ip, phone, "a@b.org"):
            old = old.replace(value, brute(value))
        assert new == old


def test_dates_link_across_spellings(spark):
    a, b, c, d, e = run(spark, ["2024-03-25", "2024/03/25", "03/25/2024", "25.03.2024", "25/03/2024"])
    y, m, day = a.split("-")
    assert (b, c, d) == (f"{y}/{m}/{day}", f"{m}/{day}/{y}", f"{day}.{m}.{y}")
    assert e == f"{day}/{m}/{y}"


@pytest.mark.parametrize("sizes", [(7, 11), (10, 100), (189, 773)])
def test_the_network_is_a_permutation(sizes):
    seen = {network(x, y, sizes, "t") for x in range(sizes[0]) for y in range(0, sizes[1])}
    assert len(seen) == sizes[0] * sizes[1]


def test_edges(spark):
    rows = [(1, None, 4, "a"), (1, "", 0, "b"), (None, "at 1.2.3.4 end", 3, "c"), (2, "x" * 200_000 + " 1.2.3.4", 5, "d"), (2, "no data", None, "e"), (2, "no data", None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, n_pii string")
    out = P.pseudonymise(docs, KEY, count_col="n_pii")
    got = out.collect()
    assert out.columns == ["doc_id", "text", "n_chars", "n_pii"] and len(got) == 6
    assert [r["n_pii"] for r in got] == [0, 0, 1, 1, 0, 0]
    assert got[0]["text"] is None and got[0]["n_chars"] == 4 and got[1]["text"] == ""
    assert got[2]["text"] == f"at {brute('1.2.3.4')} end" and got[2]["n_chars"] == len(got[2]["text"])
    assert got[3]["text"].startswith("x" * 200_000 + " ")
    assert P.pseudonymise(docs.limit(0), KEY).count() == 0


def test_no_column_name_shows_what_was_found(spark):
    names = ["fathomline pii hits", "pii hits", "PII HITS_", "a.b", "it`s"]
    docs = spark.createDataFrame([(1, "at 42.144.35.254 end", *["own"] * 5)], "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names))
    out = P.pseudonymise(docs, KEY, count_col="n_pii")
    assert out.columns == [*docs.columns, "n_pii"]
    assert out.collect()[0][1:-1] == (f"at {brute('42.144.35.254')} end", *["own"] * 5)


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = P.pseudonymise(docs, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Exchange" not in plan
