"""Pseudonyms for personal data, by DataFrame functions alone.

Numbers and dates that pass their validation are moved by a keyed Feistel permutation inside their own format, so the
result is again a valid card number, phone number, address or date, and equal values get equal pseudonyms in every
document. Phone numbers are any ten digits in one of the layouts of SHAPES; those with an area code or exchange that
begins with 0 or 1 (which nobody has) are permuted among themselves. Card numbers are runs of 13 to 19 digits whose last
is the Luhn check digit of the others, also in groups of 4-4-4-4 or 4-6-5; other runs (identifiers, time stamps) stay as they are.
Dates are 2020-12-25, and 25.12.2020 or 25/12/2020, with one or two digits; 12/25/2020 is read month first because it is no day otherwise. E-mail addresses have no fixed digit format; they
get a keyed digest as local part and domain.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "card", "ssn", "date", "ip")

EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
PHONE = r"(?:\+1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[.-][0-9]++|\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9]|[-./][0-9])"
CARD4 = r"[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])"
NUMBER = r"[0-9]++(?:[-./][0-9]++)*+"
CANDIDATE = f"{EMAIL}|{PHONE}|{CARD4}|{NUMBER}"

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SHAPES = {
    "email": f"^{EMAIL}$",
    "phone": r"^(?:(?:\+1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[.-][0-9]{4}|\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}|(?:1[.-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "date": r"^(?:(?:18|19|20|21)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./](?:18|19|20|21)[0-9]{2})$",
    "ip": rf"^{OCTET}(?:\.{OCTET}){{3}}$",
}
#: 400 years of the calendar from 1800-01-01 are 146097 = 773 * 189 days.
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 773, 189
#: Without the first twelve of each of their 4800 months, 9 * 9833 days.
LATE_A, LATE_B, MONTHS = 9, 9833, 4800


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(x: str, a: str, b: str, tag: str, rounds: int = 4) -> str:
    """SQL that permutes the integer x of [0, a*b): halves x div b and x mod b, each moved by a digest of the other under __key."""
    f = lambda side, half: f"cast(conv(substring(md5(concat_ws(':', __key, {_q(tag)}, {_q(side)}, i, {half})), 1, 13), 16, 10) as bigint)"
    left = f"pmod(s.l + {f('l', 's.r')}, {a})"
    return (
        f"aggregate(sequence(1, {rounds}), named_struct('l', cast(({x}) div ({b}) as bigint), 'r', cast(pmod({x}, {b}) as bigint)), "
        f"(s, i) -> transform(array({left}), l -> named_struct('l', l, 'r', pmod(s.r + {f('r', 'l')}, {b})))[0], "
        f"s -> s.l * ({b}) + s.r)"
    )


def _luhn(digits: str) -> str:
    """SQL for the check digit that belongs after a string of digits."""
    n = f"length({digits})"
    d = f"cast(substring({digits}, {n} - i, 1) as int)"
    return f"pmod(10 - pmod(aggregate(sequence(0, {n} - 1), 0, (t, i) -> t + case when i % 2 = 0 then 2 * {d} - case when {d} > 4 then 9 else 0 end else {d} end), 10), 10)"


def _fill(shape: str, digits: str) -> str:
    """SQL that writes digits over the digits of shape, in order; other characters stay."""
    return (
        f"aggregate(split({shape}, ''), named_struct('out', '', 'k', 1), (s, c) -> "
        f"case when c >= '0' and c <= '9' then named_struct('out', concat(s.out, substring({digits}, s.k, 1)), 'k', s.k + 1) "
        f"else named_struct('out', concat(s.out, c), 'k', s.k) end, s -> s.out)"
    )


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with name bound to value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: The day that m tells: year first, or day first; month first only where that is no day.
DAY = "coalesce(try_to_date(m, 'yyyy-MM-dd'), try_to_date(translate(m, '/', '.'), 'd.M.yyyy'))"
MONTH_FIRST = "try_to_date(translate(m, '/', '.'), 'M.d.yyyy')"


def _written(day: str, first: str, second: str) -> str:
    """SQL for a day in the layout of m: its separator, and blanks for leading zeros if m leaves one out."""
    sign = "substring(m, length(m) - 4, 1)"
    shape = lambda n: f"concat({', '.join([_q(first * n), sign, _q(second * n), sign])}, 'yyyy')"
    return f"case when length(m) < 10 then date_format({day}, {shape(1)}) else date_format({day}, {shape(2)}) end"


def _pseudonym(kind: str) -> str:
    """SQL for the pseudonym of m, a match of the kind, under the key in column __key."""
    if kind == "email":
        digest = lambda part: f"sha2(concat_ws(':', __key, lower({part})), 256)"
        return f"concat('u', substring({digest('m')}, 1, 20), '@h', substring({digest('substring_index(m, chr(64), -1)')}, 1, 16), '.example')"
    digits = "regexp_replace(m, '[^0-9]', '')"
    if kind == "phone":
        # area and exchange begin with 2-9: 800 * 800 * 10000 = 80000 * 80000 numbers; a leading 1 is the country's
        # all others (area or exchange begins with 0 or 1) stay among themselves: 360000 * 10000 = 60000 * 60000 numbers
        area, exchange, line = (f"cast(substring(d, {k}, {n}) as bigint)" for k, n in ((1, 3), (4, 3), (7, 4)))
        x = f"(({area} - 200) * 800 + {exchange} - 200) * 10000 + {line}"
        out = "concat(200 + y div 8000000, 200 + pmod(y div 10000, 800), lpad(cast(pmod(y, 10000) as string), 4, '0'))"
        x0 = f"case when {area} < 200 then {area} * 1000 + {exchange} else 200000 + ({area} - 200) * 200 + {exchange} end * 10000 + {line}"
        pair = "case when y div 10000 < 200000 then y div 10000 else 200000 + (y div 10000 - 200000) div 200 * 1000 + pmod(y div 10000 - 200000, 200) end"
        out0 = f"concat(lpad(cast({pair} as string), 6, '0'), lpad(cast(pmod(y, 10000) as string), 4, '0'))"
        new = f"case when d rlike '^[2-9]..[2-9]' then {_let('y', _feistel(x, '80000L', '80000L', kind), out)} else {_let('y', _feistel(x0, '60000L', '60000L', 'phone01'), out0)} end"
        return _let("d", f"right({digits}, 10)", _fill("m", f"concat(case when length({digits}) = 11 then '1' else '' end, {new})"))
    if kind == "card":
        # all digits but the last are permuted; the last is their check digit
        p = "substring(d, 1, length(d) - 1)"
        half = "cast(power(10, (length(d) - 1) div 2) as bigint)"
        other = "cast(power(10, length(d) - 1 - (length(d) - 1) div 2) as bigint)"
        new = f"lpad(cast({_feistel(f'cast({p} as bigint)', other, half, kind)} as string), length(d) - 1, '0')"
        return _let("d", digits, _let("y", new, _fill("m", f"concat(y, {_luhn('y')})")))
    if kind == "ssn":
        # 898 areas (not 000, 666, 900-999), 99 groups, 9999 serials
        area = "cast(substring(m, 1, 3) as bigint)"
        x = f"({area} - case when {area} > 666 then 2 else 1 end) * 989901 + (cast(substring(m, 5, 2) as bigint) - 1) * 9999 + cast(substring(m, 8, 4) as bigint) - 1"
        a = "y div 989901"
        out = f"concat(lpad(cast({a} + case when {a} >= 665 then 2 else 1 end as string), 3, '0'), '-', lpad(cast(pmod(y, 989901) div 9999 + 1 as string), 2, '0'), '-', lpad(cast(pmod(pmod(y, 989901), 9999) + 1 as string), 4, '0'))"
        return _let("y", _feistel(x, "898L", "989901L", kind), out)
    if kind == "date":
        since = lambda d: f"cast(datediff({d}, date'{FIRST_DAY}') as bigint)"
        all_days = f"date_add(date'{FIRST_DAY}', cast({_feistel(since(DAY), f'{DAYS_A}L', f'{DAYS_B}L', kind)} as int))"
        iso = f"date_format({all_days}, 'yyyy-MM-dd')"
        # month first is what can't be day first: days from the 13th on, which are permuted among themselves. The k-th of them lies in
        # the last month that has no more than k of them before it; months have 13 to 19 of them each, so a few guesses do
        month = f"cast(months_between(trunc({MONTH_FIRST}, 'MM'), date'{FIRST_DAY}') as bigint)"
        before = "datediff(add_months(first, cast(n as int)), first) - 12 * n".replace("first", f"date'{FIRST_DAY}'")
        guess = f"k * {MONTHS} div {LATE_A * LATE_B}"
        found = f"array_max(filter(sequence(greatest(0L, {guess} - 3), least({MONTHS - 1}L, {guess} + 3)), n -> {before} <= k))"
        late = _let("k", _feistel(f"({since(MONTH_FIRST)} - 12 * ({month} + 1))", f"{LATE_A}L", f"{LATE_B}L", "month", rounds=8), f"date_add(date'{FIRST_DAY}', cast(k + 12 * ({found} + 1) as int))")
        return f"case when substring(m, 5, 1) = '-' then {iso} when {DAY} is not null then {_let('y', all_days, _written('y', 'd', 'M'))} else {_let('y', late, _written('y', 'M', 'd'))} end"
    octet = lambda k: f"cast(split(m, '\\\\.')[{k}] as bigint)"
    x = f"(({octet(0)} * 256 + {octet(1)}) * 256 + {octet(2)}) * 256 + {octet(3)}"
    return _let("y", _feistel(x, "65536L", "65536L", kind), "concat_ws('.', y div 16777216, pmod(y div 65536, 256), pmod(y div 256, 256), pmod(y, 256))")


def _valid(kind: str) -> str:
    test = f"m rlike {_q(SHAPES[kind])}"
    if kind == "date":
        test += f" and coalesce({DAY}, {MONTH_FIRST}) is not null"
    if kind == "card":
        digits = "regexp_replace(m, '[^0-9]', '')"
        # a case, so that the check digit is computed for runs of the right length alone
        test = f"case when {test} then {_let('d', digits, 'cast(right(d, 1) as int) = ' + _luhn('substring(d, 1, length(d) - 1)'))} else false end"
    if kind == "email":
        test += " and m rlike '[.][A-Za-z]{2,}$'"
    return test


#: Lengths are added up in runs of so many, so that a text with n candidates costs about n * STRIDE steps.
STRIDE = 256


def _starts() -> str:
    """SQL for where each hit begins: sums of the lengths of the gaps and values before it."""
    step = "length(g) + length(coalesce(x.value, ''))"
    rises = f"zip_with(slice(__gaps, 1, size(__hits)), __hits, (g, x) -> {step})"
    sums = "aggregate(r, cast(array(0) as array<int>), (s, v) -> array_append(s, s[size(s) - 1] + v))"  # one more than r, from 0
    chunks = f"transform(sequence(0, (size(r) - 1) div {STRIDE}), c -> {_let('r', f'slice(r, c * {STRIDE} + 1, {STRIDE})', sums)})"
    bases = "aggregate(chunks, cast(array(0) as array<int>), (s, c) -> array_append(s, s[size(s) - 1] + c[size(c) - 1]))"
    ends = f"flatten({_let('bases', bases, 'transform(chunks, (c, k) -> transform(slice(c, 2, size(c)), e -> e + bases[k]))')})"
    ends = _let("r", rises, _let("chunks", chunks, ends))
    return f"zip_with({ends}, __hits, (e, x) -> e - length(x.value))"


#: What queries and the pipeline use where spark.veilframe.pii.key is not set: anybody knows it, so it hides nothing.
TRIAL_KEY = "a key for trials"


def session_key(spark) -> str:
    """The secret of spark.veilframe.pii.key, or a new random one, with which pseudonyms link within one call alone."""
    return spark.conf.get("spark.veilframe.pii.key", None) or secrets.token_hex(16)


def pseudonymise(df: DataFrame, text: str = "text", key: str | None = None, out: str | None = None, found: str = "pii") -> DataFrame:
    """Replace personal data in a text column by pseudonyms under a secret key (session_key() if none is given); add `found`, an array of structs (kind, start, value, pseudonym).

    Candidates are the leftmost, longest runs that look like an e-mail address, phone number or group of digits; those
    that no validation accepts stay as they are. The key is a one-row table that the plan reads; the plan's text, and so event logs,
    don't show it. The text is split at the candidates and put together again, in
    whole-row expressions: no shuffle, no Python. start is the 0-based code point in the input text.

    Null text: null, with an empty array. Empty text: empty. Texts of any length are treated whole. A value that
    occurs twice is replaced twice, by the same pseudonym. Empty tables give empty tables; other columns pass
    through (a column already named like `found` is replaced).
    """
    key = session_key(df.sparkSession) if key is None else key
    secret = df.sparkSession.sql("select key from values (:key) as t(key)", args={"key": key}).scalar()
    gaps = f"split(__t, {_q(CANDIDATE)}, -1)"
    parts = f"regexp_extract_all(__t, {_q(CANDIDATE)}, 0)"
    kind = "case " + " ".join(f"when {_valid(k)} then '{k}'" for k in KINDS) + " end"
    value = "case x.kind " + " ".join(f"when '{k}' then transform(array(x.value), m -> {_pseudonym(k)})[0]" for k in KINDS) + " else x.value end"
    work = (
        df.withColumns({"__t": F.col(text).cast("string"), "__key": secret})
        .withColumn("__gaps", F.expr(gaps))
        .withColumn("__hits", F.expr(f"transform({parts}, m -> named_struct('kind', {kind}, 'value', m))"))
        .withColumn("__new", F.expr(f"transform(__hits, x -> {value})"))
    )
    whole = F.expr("array_join(flatten(zip_with(__gaps, __new, (g, n) -> array(g, coalesce(n, '')))), '')")
    starts = F.expr(_starts())
    hits = F.when(F.size("__hits") > 0, starts)
    work = work.withColumn("__at", hits).withColumn(
        found,
        F.expr(
            "coalesce(filter(zip_with(zip_with(__hits, __new, (x, n) -> named_struct('kind', x.kind, 'value', x.value, 'pseudonym', n)), "
            "coalesce(__at, cast(array() as array<int>)), (x, s) -> named_struct('kind', x.kind, 'start', s, 'value', x.value, 'pseudonym', x.pseudonym)), "
            "x -> x.kind is not null), cast(array() as array<struct<kind:string,start:int,value:string,pseudonym:string>>))"
        ),
    )
    return work.withColumn(out or text, F.when(F.size("__hits") > 0, whole).otherwise(F.col("__t"))).drop("__t", "__gaps", "__hits", "__new", "__at", "__key")
