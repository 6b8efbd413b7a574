"""Pseudonyms: which values are replaced, and that they stay in their format and class."""

import re

from veilframe.llm import pii


def found(spark, texts):
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    return [(r.text, [(x.kind, x.value, x.pseudonym) for x in r.pii]) for r in rows]


def test_phone_numbers_of_every_area_code_and_layout(spark):
    phones = [
        "+1 (017) 555-7713", "+1 (132) 555-1352", "(415) 055-0134", "017-555-7713", "(999) 199-9999", "(000) 000-0000", "+1 (415) 555-0134",
        "+1-415-555-0134", "415.555.0134", "+1 415 555 0134", "+14155550134", "1-415-555-0134",
    ]
    for phone, (text, hits) in zip(phones, found(spark, [f"call {p}, now" for p in phones]), strict=True):
        (kind, value, new), low = hits[0], lambda p: [c in "01" for c in re.sub("[^0-9]", "", p)[-10:][0:4:3]]
        assert len(hits) == 1 and (kind, value) == ("phone", phone) and new != phone and text == f"call {new}, now"
        assert re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", phone) and new.startswith("+1") == phone.startswith("+1")
        assert any(low(new)) == any(low(phone))
    same = {re.sub("[^0-9]", "", h[0][2])[-10:] for _, h in found(spark, ["+1 (415) 555-0134", "415-555-0134", "415.555.0134"])}
    assert len(same) == 1


def test_phones_that_nobody_has_are_permuted_one_to_one(spark):
    ends = ("000", "001", "199", "200", "201", "999")
    phones = [f"{a}-{e}-{n}" for a in ends for e in ends for n in ("0000", "9999")]
    new = [h[0][2] for _, h in found(spark, phones)]
    assert len(set(new)) == len(phones) and all(re.fullmatch("[0-9]{3}-[0-9]{3}-[0-9]{4}", p) for p in new)


def test_longer_numbers_are_no_phones(spark):
    texts = ["(415) 555-01345", "415-555-01345", "+1-415-555-0134-99", "415.555.0134.7", "4155550134", "2-415-555-0134"]
    assert [h for _, h in found(spark, texts)] == [[]] * len(texts)


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_cards_must_pass_luhn(spark):
    body = ["411111111111111", "980791576280449", "000000000000", "123456789012345678"]
    good = [next(b + str(c) for c in range(10) if luhn(b + str(c))) for b in body] + ["4111 1111 1111 1111", "4111-1111-1111-1111"]
    for card, (text, hits) in zip(good, found(spark, [f"pay {c}." for c in good]), strict=True):
        assert [h[:2] for h in hits] == [("card", card)] and text == f"pay {hits[0][2]}."
        assert luhn(re.sub("[^0-9]", "", hits[0][2])) and re.sub("[0-9]", "0", hits[0][2]) == re.sub("[0-9]", "0", card)
    bad = [b + str(c) for b in body for c in range(10) if not luhn(b + str(c))] + ["9807915762804490", "4111 1111 1111 1112", "1700000000001"]
    assert not any(luhn(re.sub("[^0-9]", "", b)) for b in bad)
    assert found(spark, bad) == [(b, []) for b in bad]


def test_cards_of_four_six_and_five(spark):
    for text, hits in found(spark, ["3782-822463-10005", "no. 3782 822463 10005!", "3782-822463-10006", "3782-822463-100051"]):
        for kind, value, new in hits:
            assert kind == "card" and luhn(re.sub("[^0-9]", "", new)) and re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", value) and new in text and new != value
    assert [len(h) for _, h in found(spark, ["3782-822463-10005", "no. 3782 822463 10005!", "3782-822463-10006", "3782-822463-100051"])] == [1, 1, 0, 0]


def test_dates_of_every_layout_are_permuted_in_it(spark):
    import datetime

    day = datetime.date(1999, 12, 1)
    days = [day + datetime.timedelta(k) for k in range(450)] + [datetime.date(1800, 1, 1), datetime.date(1800, 1, 13), datetime.date(2199, 12, 31), datetime.date(2199, 12, 13)]
    layouts = {"ymd": lambda d: f"{d:%Y-%m-%d}", "d.m": lambda d: f"{d:%d.%m.%Y}", "m/d": lambda d: f"{d:%m/%d/%Y}", "short": lambda d: f"{d.day}/{d.month}/{d.year}", "short m/d": lambda d: f"{d.month}/{d.day}/{d.year}"}
    for name, write in layouts.items():
        texts = sorted({write(d) for d in days if "m/d" not in name or d.day > 12})
        new = []
        for value, (text, hits) in zip(texts, found(spark, texts), strict=True):
            assert [h[:2] for h in hits] == [("date", value)] and text == hits[0][2]
            new.append(text)
        assert len(set(new)) == len(texts)
        for value, t in zip(texts, new):
            a, b, c = map(int, re.split("[-./]", t))
            d = datetime.date(a, b, c) if name == "ymd" else datetime.date(c, a, b) if "m/d" in name else datetime.date(c, b, a)
            assert datetime.date(1800, 1, 1) <= d <= datetime.date(2199, 12, 31) and (d.day > 12 or "m/d" not in name)
            assert t == (write(d) if len(value) < 10 or "short" not in name else layouts["m/d"](d) if "m/d" in name else f"{d:%d/%m/%Y}")
    assert [h for _, h in found(spark, ["13/13/2020", "2/30/2020", "31.4.2020", "1/2/20"])] == [[]] * 4


def test_the_key_is_not_in_the_plan(spark):
    out = pii.pseudonymise(spark.createDataFrame([("2020-02-29",)], "text string"), key="nobody-may-read-this")
    assert out.first().text != "2020-02-29"
    assert "nobody-may-read-this" not in out._jdf.queryExecution().toString()
