"""Format-preserving pseudonyms by a keyed Feistel permutation."""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import text_batches

ROUNDS = 8
_LOWER, _UPPER, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "abcdef"
_ACCENTS = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_ACCENTS_UP = "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Permutation of 0..n-1 for any n: a balanced network over enough bits, walked until inside."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = hashlib.blake2b(key, digest_size=32).digest(), back

    def _round(self, kind: bytes, n: int, i: int, value: int, half: int) -> int:
        data = b"%d:%d:%d" % (n, i, value)
        size = min(64, (half + 7) // 8 + 8)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, person=kind[:16], digest_size=size).digest(), "big") % (1 << half)

    def __call__(self, kind: bytes, x: int, n: int) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            if self.back:
                for i in reversed(range(ROUNDS)):
                    a, b = b ^ self._round(kind, n, i, a, half), a
            else:
                for i in range(ROUNDS):
                    a, b = b, a ^ self._round(kind, n, i, b, half)
            x = a << half | b
            if x < n:
                return x


def _by_class(permute: Feistel, kind: bytes, text: str, alphabets: tuple[str, ...]) -> str:
    """Permute all strings with the same pattern of character classes; other characters stay."""
    of = [next((a for a in alphabets if c in a), None) for c in text]
    x, n = 0, 1
    for c, a in zip(text, of):
        if a:
            x, n = x * len(a) + a.index(c), n * len(a)
    if n == 1:
        return text
    x = permute(kind, x, n)
    out = []
    for c, a in zip(reversed(text), reversed(of)):
        if a:
            x, at = divmod(x, len(a))
            c = a[at]
        out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """The check digit behind ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _into(shape: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and int(digits[-1]) == _luhn(digits[:-1])


def _card(p: Feistel, m: re.Match) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not _is_card(digits):
        return None
    own = _by_class(p, b"card", digits[:-1], (_DIGITS,))
    while len(set(own)) == 1:  # all one digit is not taken for a card, so never given out
        own = _by_class(p, b"card", own, (_DIGITS,))
    return _into(m[0], own + str(_luhn(own)))


def _number(p: Feistel, m: re.Match) -> str | None:
    """A long number that is not a valid card keeps its length, and stays none."""
    digits = m[0]
    if len(digits) < 13 or len(digits) > 19 or len(set(digits)) == 1 or int(digits[-1]) == _luhn(digits[:-1]):
        return None
    while True:
        digits = _by_class(p, b"number", digits, (_DIGITS,))
        if len(set(digits)) > 1 and int(digits[-1]) != _luhn(digits[:-1]):
            return digits


def _phone(p: Feistel, m: re.Match) -> str | None:
    lead, rest = m["lead"] or "", m[0][len(m["lead"] or "") :]
    return lead + _by_class(p, b"phone", rest, (_DIGITS,))


def _social(p: Feistel, m: re.Match) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    digits = re.sub(r"\D", "", m[0])
    if not valid(digits):
        return None
    digits = _by_class(p, b"social", digits, (_DIGITS,))
    while not valid(digits):
        digits = _by_class(p, b"social", digits, (_DIGITS,))
    return _into(m[0], digits)


def _address(p: Feistel, m: re.Match) -> str | None:
    parts = m[0].split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    x = p(b"address", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(p: Feistel, m: re.Match) -> str | None:
    """The day is permuted, so one day in two notations stays one day; ambiguous ones count day first."""
    text = m[0]
    sep = re.search(r"\D", text)[0]
    parts = text.split(sep)
    year_first = len(parts[0]) == 4
    y, mo, d = map(int, parts if year_first else (parts[2], parts[1], parts[0]))
    month_first = not year_first and mo > 12
    if month_first:
        mo, d = d, mo
    try:
        day = datetime.date(y, mo, d).toordinal()
    except ValueError:
        return None
    if not _FIRST_DAY <= day <= _LAST_DAY:
        return None
    # a date read month first is recognised again only with a day above twelve
    while True:
        day = _FIRST_DAY + p(b"date", day - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1)
        new = datetime.date.fromordinal(day)
        if not month_first or new.day > 12:
            break
    wide = all(len(x) != 1 for x in parts)
    two = (lambda n: f"{n:02d}") if wide else str
    ymd = [f"{new.year:04d}", two(new.month), two(new.day)]
    return sep.join(ymd if year_first else [ymd[1], ymd[2], ymd[0]] if month_first else ymd[::-1])


def _iban_check(country: str, rest: str) -> int:
    """Check number that makes the whole come to 1 modulo 97."""
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return 98 - int(number) % 97


def _is_iban(plain: str) -> bool:
    return 15 <= len(plain) <= 34 and int(plain[2:4]) == _iban_check(plain[:2], plain[4:])


def _iban(p: Feistel, m: re.Match) -> str | None:
    plain = m[0].replace(" ", "")
    if not _is_iban(plain):
        return None
    country, rest = plain[:2], plain[4:]
    rest = _by_class(p, b"iban", rest, (_DIGITS, _UPPER))
    new = iter(f"{country}{_iban_check(country, rest):02d}{rest}")
    return "".join(c if c == " " else next(new) for c in m[0])


def _mail(p: Feistel, m: re.Match) -> str | None:
    name, _, host = m[0].rpartition("@")
    return _by_class(p, b"mail", name, (_LOWER, _UPPER, _DIGITS, _ACCENTS, _ACCENTS_UP)) + "@" + host


def _secret(p: Feistel, m: re.Match) -> str | None:
    text = m[0]
    if not any(c.isdigit() for c in text) or not any(c.isalpha() for c in text):
        return None
    lower = any(c in _HEX for c in text)
    if lower and any(c in _HEX.upper() for c in text):
        return None
    alphabet = _DIGITS + (_HEX if lower else _HEX.upper())
    new = _by_class(p, b"secret", text, (alphabet,))
    while not any(c.isdigit() for c in new) or not any(c.isalpha() for c in new):
        new = _by_class(p, b"secret", new, (alphabet,))
    return new


# characters of an account number by country, as registered
_IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(n: int) -> re.Pattern:
    groups, rest = divmod(n - 4, 4)
    last = f"(?: ?[A-Z0-9]{{{rest}}})" if rest else ""
    return re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{last}(?![A-Za-z0-9])")


_IBAN_BY_COUNTRY = {c: _iban_of(n) for n, countries in _IBAN_CHARS.items() for c in countries.split()}
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD_SHAPES = [
    re.compile(r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])"),
    re.compile(r"[0-9]{4}([ -])(?:[0-9]{4}\1){3}[0-9]{1,3}(?![0-9])"),
    re.compile(r"[0-9]{4}([ -])[0-9]{6}\1[0-9]{4,5}(?![0-9])"),
]


def _valid_iban(shape: re.Pattern | None, text: str, at: int) -> re.Match | None:
    m = shape and shape.match(text, at)
    return m if m and _is_iban(m[0].replace(" ", "")) else None


def _iban_at(text: str, at: int) -> re.Match | None:
    """The account number of its country's length that begins there."""
    return _valid_iban(_IBAN_BY_COUNTRY.get(text[at : at + 2]), text, at)


def _other_iban_at(text: str, at: int) -> re.Match | None:
    """One of another length, as far as its groups go."""
    return None if _iban_at(text, at) else _valid_iban(_IBAN, text, at)


def _card_at(text: str, at: int) -> re.Match | None:
    """The grouped card that begins there; what stands behind it is looked at only where the check fails."""
    for shape in _CARD_SHAPES:
        m = shape.match(text, at)
        if m and _is_card(re.sub(r"\D", "", m[0])):
            return m
    return None


# values of groups, told by their check alone: every start is tried
_AT_START = {"iban": _iban_at, "other iban": _other_iban_at, "grouped card": _card_at}
_WIDEST = 43  # 34 characters and the blanks between their groups

# in order of precedence; a place taken by one is not offered to the next
RULES: list[tuple[str, re.Pattern, Callable]] = [
    ("mail", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}"), _mail),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9]{4})"), _iban),
    ("other iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9]{4})"), _iban),
    ("secret", re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,128}(?![A-Za-z0-9])"), _secret),
    ("address", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"), _address),
    ("date", re.compile(r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9]|[./-][0-9])"), _date),
    ("social", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"), _social),
    ("phone", re.compile(r"(?<![0-9+])(?P<lead>\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|-[0-9])"), _phone),
    ("grouped card", re.compile(r"(?<![0-9])[0-9]{4}(?=[ -][0-9]{4})"), _card),
    ("card", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])"), _card),
    ("number", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])"), _number),
]
_SIGNAL, _AT, _NAME = re.compile("[0-9@]"), re.compile("@"), re.compile(r"[\w.%+-]{1,64}\Z")


def _found(name: str, rule: re.Pattern, text: str):
    if name != "mail":
        yield from rule.finditer(text)
        return
    # from each at-sign leftwards: trying every word for a name costs far more
    for at in _AT.finditer(text):
        left = _NAME.search(text, max(0, at.start() - 64), at.start())
        if left and (m := rule.match(text, left.start())):
            yield m


def _grouped(name: str, rule: re.Pattern, fn: Callable, text: str, permute: Feistel, taken: list[tuple[int, int, str, str]]) -> None:
    """Add to ``taken`` the values of groups, from left to right.

    A value is permuted on until it is found in the same place: no other length of it and no start before
    it that failed may pass the check, so that the way back finds what the way there gave out.
    """
    at_start, failed, end = _AT_START[name], [], 0
    for x, y, _, _ in taken:  # whatever stands there, it is no part of a candidate
        text = text[:x] + "\0" * (y - x) + text[y:]
    for start in rule.finditer(text):
        a = start.start()
        if a < end:
            continue
        m = at_start(text, a)
        if m is None:
            failed.append(a)
            continue
        b = m.end()
        low = max(0, a - _WIDEST)
        near = [x - low for x in failed if x >= low]
        new = fn(permute, m)
        while True:
            changed = text[low:a] + new + text[b : b + _WIDEST]
            again = at_start(changed, a - low)
            if again and again.end() == b - low and not any(at_start(changed, x) for x in near):
                break
            new = fn(permute, re.fullmatch(".*", new))
        taken.append((a, b, new, name.split()[-1]))
        end = b


def _in_line(text: str, permute: Feistel) -> tuple[str, list[str]]:
    taken: list[tuple[int, int, str, str]] = []
    for name, rule, fn in RULES:
        if name in _AT_START:
            _grouped(name, rule, fn, text, permute, taken)
            continue
        for m in _found(name, rule, text):
            if any(m.start() < b and a < m.end() for a, b, _, _ in taken):
                continue
            new = fn(permute, m)
            if new is not None:
                taken.append((m.start(), m.end(), new, name))
    out, at = [], 0
    for a, b, new, _ in sorted(taken):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [t[3] for t in sorted(taken)]


def replace(text: str, permute: Feistel) -> tuple[str, list[str]]:
    """The text with every recognised value replaced, and the kinds of these in order.

    No value spans lines, and all have a digit or an at-sign, so other lines are passed over.
    """
    out, kinds, at = [], [], 0
    while m := _SIGNAL.search(text, at):
        a = text.rfind("\n", at, m.start()) + 1 or at
        b = text.find("\n", m.start())
        b = len(text) if b < 0 else b
        line, found = _in_line(text[a:b], permute)
        out += [text[at:a], line]
        kinds += found
        at = b
    return ("".join([*out, text[at:]]) if kinds else text), kinds


def pseudonyms(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """Replace personal numbers and dates by keyed pseudonyms of the same format, in whole texts.

    Cards (check digit; grouped ones whatever groups stand around them), account numbers (mod 97; of their
    country's length, else as far as their groups go), calendar dates of 1900-2099, dotted addresses, social
    numbers, telephone numbers, other numbers of 13 to 19 digits, mail names and hexadecimal secrets are
    recognised and, where the format has a check, validated; what fails it is left. A value is
    permuted by a Feistel network over all values of its format, keyed by ``key``, so equal values get
    equal pseudonyms in every document, different ones different, checks still hold, and ``back``
    with the key undoes it. Layout (blanks, brackets, country codes, hosts) stays.

    One pass without a shuffle. Returns the columns of ``docs`` with the new text, plus n_values (long) and
    kinds (array<string>, in order of the text); columns of these names are replaced. A null text stays
    null, with 0 values. Other columns, ids included, are not touched, whatever they hold.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_values", "kinds")])
    own = docs.columns
    at = own.index("text")

    def rows(batches):
        permute = Feistel(key, back)
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(at)], names=["row", "text"])
            done = 0
            for names, texts in text_batches([numbered]):
                part = batch.slice(done, len(names))
                done += len(names)
                new = [(None, []) if t is None else replace(t.decode(), permute) for t in texts]
                columns = part.columns
                columns[at] = pa.array([t for t, _ in new], batch.schema.field(at).type)
                counts, kinds = pa.array([len(k) for _, k in new], pa.int64()), pa.array([k for _, k in new], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*columns, counts, kinds], names=[*own, "n_values", "kinds"])

    schema = docs.select("*", F.lit(0).cast("long").alias("n_values"), F.array(F.lit("")).alias("kinds")).schema
    return docs.mapInArrow(rows, schema)
