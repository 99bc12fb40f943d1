"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated values are permuted within their own format by a keyed Feistel network over the two halves of the
value: payment cards (Luhn), IBANs (mod 97), social security numbers, IPv4 addresses, phone numbers and calendar
dates. The network adds round values to the halves in turn, modulo the size of each half's range, so it is a
permutation of the whole range without cycle walking: equal values get equal pseudonyms in every document,
different ones different pseudonyms, and every pseudonym passes the same validation. E-mail addresses, which
have no fixed range, get a keyed name at a reserved domain.

Defined results: null text stays null with zero counts and no spans; numbers that fail their check are left as
they are; repeated rows are treated alike; extra columns are ignored; an empty table gives an empty result;
whole texts are read, spans are code points of the input text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablevec.llm.common import fresh

KINDS = ("email", "iban", "phone", "ip", "date", "ssn", "card")

_BEFORE, _AFTER = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "iban": rf"{_BEFORE}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}{_AFTER}",
    "phone": rf"(?<![0-9A-Za-z+])(?:\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,4}}(?:[ .-]?[0-9]{{2,4}}){{1,3}}|\([0-9]{{3}}\) ?[0-9]{{3}}[ .-][0-9]{{4}}|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}){_AFTER}",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": rf"{_BEFORE}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}[./][0-9]{{2}}[./][0-9]{{4}}){_AFTER}",
    "ssn": rf"{_BEFORE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_AFTER}",
    "card": rf"{_BEFORE}[0-9](?:[ -]?[0-9]){{12,18}}{_AFTER}",
}
ROUNDS = 8
#: The days of 400 Gregorian years, 27 * 5411, from 1800-01-01 on.
FIRST_DAY, DAY_HALVES = "date'1800-01-01'", (27, 5411)


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _network(l: str, r: str, left: str, right: str, tweak: str, key: str) -> str:
    """SQL for the halves ``l`` and ``r``, in [0, left) and [0, right), after all rounds: a struct of both."""

    def f(x: str) -> str:
        return f"cast(conv(substr(sha2(concat_ws(':', {_q(key)}, {tweak}, cast(i as string), cast({x} as string)), 256), 1, 14), 16, 10) as bigint)"

    return f"""aggregate(sequence(1, {ROUNDS}), struct({l} as l, {r} as r),
        (s, i) -> case when i % 2 = 1 then struct((s.l + {f("s.r")} % ({left})) % ({left}) as l, s.r as r)
                       else struct(s.l as l, (s.r + {f("s.l")} % ({right})) % ({right}) as r) end)"""


def feistel(value: str, left: str, right: str, tweak: str, key: str) -> str:
    """SQL that permutes ``value``, a bigint in [0, left * right), under the key and tweak."""
    made = _network(f"({value}) div ({right})", f"({value}) % ({right})", left, right, tweak, key)
    return _let(made, "hs", f"hs.l * ({right}) + hs.r")


def _digits(text: str, tweak: str, key: str) -> str:
    """A string of 2 to 30 digits permuted among those of its length; each half of it fits a bigint."""
    d = "dd"
    nl, nr = f"(length({d}) div 2)", f"(length({d}) - length({d}) div 2)"
    left, right = f"cast(pow(10, {nl}) as bigint)", f"cast(pow(10, {nr}) as bigint)"
    made = _network(f"cast(left({d}, cast({nl} as int)) as bigint)", f"cast(right({d}, cast({nr} as int)) as bigint)", "hl", "hr", f"concat({_q(tweak)}, length({d}))", key)
    joined = _let(made, "hs", f"concat(lpad(cast(hs.l as string), cast({nl} as int), '0'), lpad(cast(hs.r as string), cast({nr} as int), '0'))")
    return _let(text, d, _let(left, "hl", _let(right, "hr", joined)))


def _refill(m: str, d: str) -> str:
    """The digits of ``m`` replaced, in order, by those of ``d``."""
    return f"""aggregate(split({m}, ''), struct('' as o, 1 as p), (s, c) -> case when c rlike '^[0-9]$'
        then struct(concat(s.o, substr({d}, s.p, 1)) as o, s.p + 1 as p) else struct(concat(s.o, c) as o, s.p as p) end, s -> s.o)"""


def _luhn_sum(d: str) -> str:
    """Of digits that a check digit is to follow."""
    return f"""aggregate(sequence(1, length({d})), cast(0 as bigint), (t, i) -> t + case when (length({d}) - i) % 2 = 0
        then (cast(substr({d}, i, 1) as int) * 2) div 10 + (cast(substr({d}, i, 1) as int) * 2) % 10 else cast(substr({d}, i, 1) as int) end)"""


def _mod97(s: str) -> str:
    """Of letters and digits, letters counted from A = 10."""
    return f"""aggregate(split({s}, ''), 0, (t, c) -> case when c rlike '^[0-9]$' then (t * 10 + cast(c as int)) % 97
        when c rlike '^[A-Z]$' then (t * 100 + ascii(c) - 55) % 97 else t end)"""


def _rules(key: str) -> dict[str, tuple[str, str]]:
    """For each kind: SQL that holds for a valid match ``m``, and the pseudonym of such a match."""
    d = "d"  # the digits of m; bound where rules are used
    day = "coalesce(try_to_date(m, 'yyyy-MM-dd'), try_to_date(replace(m, '.', '/'), 'dd/MM/yyyy'), try_to_date(replace(m, '.', '/'), 'MM/dd/yyyy'))"
    pattern = "case when m rlike '^[0-9]{4}-' then 'yyyy-MM-dd' when try_to_date(replace(m, '.', '/'), 'dd/MM/yyyy') is not null then concat('dd', substr(m, 3, 1), 'MM', substr(m, 3, 1), 'yyyy') else concat('MM', substr(m, 3, 1), 'dd', substr(m, 3, 1), 'yyyy') end"
    days = DAY_HALVES[0] * DAY_HALVES[1]
    moved = feistel(f"cast(datediff({day}, {FIRST_DAY}) as bigint)", str(DAY_HALVES[0]), str(DAY_HALVES[1]), "'date'", key)
    octets = "split(m, '[.]')"
    ip = feistel(f"aggregate({octets}, cast(0 as bigint), (t, x) -> t * 256 + cast(x as bigint))", "65536", "65536", "'ip'", key)
    area = "(cast(substr(m, 1, 3) as bigint) - case when cast(substr(m, 1, 3) as int) > 666 then 2 else 1 end)"
    ssn = feistel(f"(({area} * 99 + cast(substr(m, 5, 2) as bigint) - 1) * 9999 + cast(substr(m, 8, 4) as bigint) - 1)", "88902", "9999", "'ssn'", key)
    free = "case when m like '+%' then regexp_replace(regexp_extract(m, '^[+][0-9]{1,3}(?=[^0-9]|$)', 0), '[^0-9]', '') else '' end"
    plain = "replace(m, ' ', '')"
    body = _let(f"substr({plain}, 5)", "y", _let("regexp_replace(y, '[^0-9]', '')", "q", _let(f"case when length(q) > 1 then {_digits('q', 'iban', key)} else q end", "n", _refill("y", "n"))))
    spaced = """aggregate(split(m, ''), struct('' as o, 1 as p), (s, c) -> case when c = ' ' then struct(concat(s.o, c) as o, s.p as p)
        else struct(concat(s.o, substr(z, s.p, 1)) as o, s.p + 1 as p) end, s -> s.o)"""
    iban = _let(body, "b", _let(f"concat(substr(m, 1, 2), lpad(cast(98 - {_mod97("concat(b, substr(m, 1, 2), '00')")} as string), 2, '0'), b)", "z", spaced))
    card = _let(f"left({d}, length({d}) - 1)", "h", _let(_digits("h", "card", key), "w", _let(f"concat(w, cast((10 - {_luhn_sum('w')} % 10) % 10 as string))", "z", _refill("m", "z"))))
    return {
        "email": ("true", f"concat('user-', substr(sha2(concat_ws(':', {_q(key)}, 'email', lower(m)), 256), 1, 16), '@example.invalid')"),
        "iban": (f"length({plain}) between 15 and 34 and {_mod97(f'concat(substr({plain}, 5), left({plain}, 4))')} = 1", iban),
        "phone": (f"length({d}) between 7 and 15", _let(f"substr({d}, length({free}) + 1)", "h", _let(f"concat({free}, {_digits('h', 'phone', key)})", "z", _refill("m", "z")))),
        "ip": (f"forall({octets}, x -> cast(x as int) <= 255)", _let(ip, "v", "concat_ws('.', cast(v div 16777216 as string), cast(v div 65536 % 256 as string), cast(v div 256 % 256 as string), cast(v % 256 as string))")),
        "date": (f"coalesce(datediff({day}, {FIRST_DAY}) between 0 and {days - 1}, false)", f"date_format(date_add({FIRST_DAY}, cast({moved} as int)), {pattern})"),
        "ssn": ("cast(left(m, 3) as int) between 1 and 899 and left(m, 3) <> '666' and substr(m, 5, 2) <> '00' and substr(m, 8) <> '0000'", _let(ssn, "v", "concat_ws('-', lpad(cast(v div 989901 + 1 + cast(v div 989901 >= 665 as int) as string), 3, '0'), lpad(cast(v div 9999 % 99 + 1 as string), 2, '0'), lpad(cast(v % 9999 + 1 as string), 4, '0'))")),
        "card": (f"{_luhn_sum(f'left({d}, length({d}) - 1)')} % 10 = (10 - cast(right({d}, 1) as int)) % 10", card),
    }


def found(text: str, key: str) -> Column:
    """An array of (kind, s, e, new) for the valid values of the column ``text``, in order."""
    rx = _q("|".join(PATTERNS.values()))
    rules = _rules(key)
    whole = {k: _q(f"^(?:{p})$".replace(_BEFORE, "").replace(_AFTER, "")) for k, p in PATTERNS.items()}
    bound = "regexp_replace(m, '[^0-9]', '')"
    kind = _let(bound, "d", "case " + " ".join(f"when m rlike {whole[k]} and {rules[k][0]} then '{k}'" for k in KINDS) + " end")
    new = _let(bound, "d", "case k " + " ".join(f"when '{k}' then {rules[k][1]}" for k in KINDS) + " end")
    t = f"`{text}`"
    made = f"""aggregate(
        zip_with(regexp_extract_all({t}, {rx}, 0), slice(split({t}, {rx}, -1), 1, size(regexp_extract_all({t}, {rx}, 0))), (m, g) -> struct(m as m, length(g) as g)),
        struct(0 as pos, cast(array() as array<struct<kind:string,s:int,e:int,m:string>>) as out),
        (a, x) -> struct(a.pos + x.g + length(x.m) as pos, concat(a.out, array(struct(
            {_let("x.m", "m", kind)} as kind, a.pos + x.g as s, a.pos + x.g + length(x.m) as e, x.m as m))) as out),
        a -> filter(a.out, x -> x.kind is not null))"""
    made = f"transform({made}, x -> struct(x.kind as kind, x.s as s, x.e as e, {_let('x.m', 'm', _let('x.kind', 'k', new))} as new))"
    return F.expr(f"case when {t} rlike '@|[0-9]' then {made} else cast(array() as array<struct<kind:string,s:int,e:int,new:string>>) end")


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the text rewritten in ``text``, and behind its columns ``pii_found`` (kind, s, e, new), or that name with more underscores where it is taken."""
    t, name = f"`{text}`", fresh(docs.columns, "pii_found")
    rebuilt = f"""aggregate({name}, struct(0 as pos, cast(array() as array<string>) as out),
        (a, x) -> struct(x.e as pos, concat(a.out, array(substring({t}, a.pos + 1, x.s - a.pos), x.new)) as out),
        a -> concat(array_join(a.out, ''), substring({t}, a.pos + 1)))"""
    return docs.withColumn(name, found(text, key)).withColumn(text, F.expr(f"case when size({name}) > 0 then {rebuilt} else {t} end"))


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the new text, counts by kind and the replaced spans."""
    new = pseudonymise(docs.select("doc_id", "text"), key)
    return new.select(
        "doc_id",
        "text",
        *[F.expr(f"cast(size(filter(pii_found, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS],
        F.expr("array_join(transform(pii_found, x -> concat_ws(':', x.kind, cast(x.s as string), cast(x.e as string))), ',')").alias("spans"),
    )
