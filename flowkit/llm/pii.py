"""Format-preserving pseudonyms for personal data.

Values are found by pattern, validated (Luhn for card numbers, modulo 97 for
IBANs, octet ranges, calendar dates, issued ranges of social security numbers)
and replaced by a keyed Feistel permutation of the values of the same format.
A permutation never merges two values, and one key gives one pseudonym for a
value wherever and however it is written, so documents stay linked. Numbers
that fail validation are left alone.

A card number or an IBAN may stand next to other numbers ("4111 1111 1111 1111
12/27"). What the pattern takes in is then cut at blanks and hyphens: a card
number is one group of digits or groups as cards show them before it is all
that the pattern found, and an IBAN has its country's length first. Inside a
run of numbers, groups of under four digits make no card number unless cards
are printed so; else nearly every list of small numbers would hold one by chance.

Phone numbers are those with a country code, in any grouping, American ones
without, and ten digits in pairs from a 0. Other national forms are not told from
plain numbers. The pseudonym keeps the country code and permutes the national digits.
Digits are those of ASCII: numbers in other scripts' digits are not looked for.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import functions as F

ROUNDS = 10

# The patterns. Each is anchored at its left end, so that scanning stays linear.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "date": r"(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|(?<=[ .-])\d{3}[ .-]|(?<![\d.-])\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d(?:[ ./()-]{0,2}\d){7,14}(?!\d)|(?<![\d.,+-])(?<!\d\d[ .-])0\d(?:(?: \d\d){4}|(?:\.\d\d){4}|(?:-\d\d){4})(?!\d|[ .-]\d\d(?!\d))",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])",
}
_ANY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items()), re.A)
_KINDS = {k: re.compile(v, re.A) for k, v in PATTERNS.items()}
_TOKEN, _DIGITS, _RUN = re.compile(r"\+?[A-Za-z0-9]+"), re.compile(r"\d+", re.A), re.compile(r"\d{1,20}(?:[ -]\d{1,20}){0,37}", re.A)
#: The groups of digits that cards show, and the length of an IBAN by its country (SWIFT's registry).
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3), (4, 4, 5), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3)}
IBAN_LENGTHS = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in countries.split()}
_MAYBE = re.compile("[0-9@]")
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Country codes of one and two digits (E.164; all others have three), and national lengths that do not vary.
_COUNTRY = re.compile(r"\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")
PHONE_LENGTHS = {"1": 10, "7": 10, "31": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "52": 10, "57": 10, "91": 10, "351": 9}
_TRUNK = re.compile(r"0\d(?:[ .-]\d\d){4}")


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): Feistel rounds over a grid of a*b >= size, walked until inside."""
    if size < 2:
        return x
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    width = a.bit_length() // 8 + 16
    while True:
        left, right = divmod(x, b)
        for i in range(ROUNDS):
            other = right if i % 2 == 0 else left
            data = f"{tweak}|{size}|{i}|{other}".encode()
            n = int.from_bytes(b"".join(blake2b(data, key=key, salt=j.to_bytes(2, "big")).digest() for j in range(-(-width // 64))), "big")
            if i % 2 == 0:
                left = (left + n) % a
            else:
                right = (right + n) % b
        x = left * b + right
        if x < size:
            return x


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10 of digits with their check digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) << (i % 2)
        total += v - 9 if v > 9 else v
    return total % 10


def _spelled(text: str, digits: str) -> str:
    """``text`` with its digits replaced in turn."""
    it = iter(digits)
    return re.sub(r"\d", lambda m: next(it), text)


def _shifted_letters(text: str, key: bytes, tweak: str) -> str:
    """Letters and digits of ``text`` permuted as one mixed-radix number; case and other characters stay."""
    size = x = 0
    size = 1
    for c in text:
        if c.isdigit():
            size, x = size * 10, x * 10 + int(c)
        elif c.isalpha():
            size, x = size * 26, x * 26 + ord(c.lower()) - 97
    x, out = permute(x, size, key, f"{tweak}|{re.sub('[a-z]', 'a', re.sub(r'[0-9]', '0', text.lower()))}"), []
    for c in reversed(text):
        if c.isdigit():
            x, v = divmod(x, 10)
            c = str(v)
        elif c.isalpha():
            x, v = divmod(x, 26)
            c = chr((65 if c.isupper() else 97) + v)
        out.append(c)
    return "".join(reversed(out))


def _trunk(value: str) -> int:
    """Where a trunk 0 in brackets may stand in an international number."""
    return re.match(r"[ .-]?", value[(at := _COUNTRY.match(value).end()) :]).end() + at


@lru_cache(100_000)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The pseudonym of a matched value, or None if it does not validate."""
    digits = "".join(c for c in value if c.isdigit())
    if kind == "email":
        name, _, top = value.rpartition(".")
        return f"{_shifted_letters(name, key, kind)}.{top}"
    if kind == "card":
        if luhn(digits) or not digits.strip("0"):
            return None
        body = f"{permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, f'{kind}{len(digits)}'):0{len(digits) - 1}d}"
        return _spelled(value, body + str(-luhn(body + "0") % 10))
    if kind == "iban":
        plain = value.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = _shifted_letters(plain[4:], key, kind)
        plain = iter(f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02d}{body}")
        return "".join(c if c == " " else next(plain) for c in value)
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255:
            return None
        n = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, kind)
        return ".".join(str(x) for x in n.to_bytes(4, "big"))
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        n = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, kind)
        n, serial = divmod(n, 9999)
        area, group = divmod(n, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "phone":
        # the country code and a trunk 0 stay, so that all ways to write a number share its national digits
        country = _COUNTRY.match(value)
        kept = len(country[1]) + value.startswith("(0)", _trunk(value)) if country else int(bool(_TRUNK.fullmatch(value)))
        rest = digits[kept:]
        return _spelled(value, digits[:kept] + f"{permute(int(rest), 10 ** len(rest), key, f'{kind}{len(rest)}'):0{len(rest)}d}")
    parts = [int(x) for x in re.split(r"[-/.]", value)]
    year, month, day = parts if "-" in value else reversed(parts)
    american = "/" in value and month > 12  # written month first
    try:
        at = datetime.date(year, *((day, month) if american else (month, day))).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= at <= _LAST_DAY - _FIRST_DAY:
        return None
    new = datetime.date.fromordinal(_FIRST_DAY + permute(at, _LAST_DAY - _FIRST_DAY + 1, key, kind))
    if "-" in value:
        return new.isoformat()
    if american:
        return f"{new.month:02d}/{new.day:02d}/{new.year}"
    return f"{new.day:02d}{'/' if '/' in value else '.'}{new.month:02d}{'/' if '/' in value else '.'}{new.year}"


def _other(text: str, start: int, end: int, but: str, key: bytes) -> int | None:
    """Where the first value of a kind other than ``but`` begins behind a group of digits in a stretch."""
    for a in (m.start() + start for m in _DIGITS.finditer(text[start:end])):
        for kind in PATTERNS if a > start else ():
            if kind == but or not (m := _KINDS[kind].match(text, a)):
                continue
            if kind == "card" and (_card(text, a, m.end(), False, key) or (0,))[0] == a or kind != "card" and pseudonym(kind, m[0], key):
                return a
    return None


def _card(text: str, start: int, end: int, whole: bool, key: bytes) -> tuple[int, int] | None:
    """Where the card number stands in the digit groups that begin at ``start``; the card pattern ends at ``end``.

    A lone group comes before groups as on cards, these before all that the
    pattern took in (if ``whole``), and that before groups of four digits or more.
    """
    groups = [(m.start() + start, m.end() + start) for m in _DIGITS.finditer(_RUN.match(text, start)[0])]
    cards = []
    for i, (a, first) in enumerate(groups):
        if a >= end:
            break
        if first - a < 4 and (i or not whole):
            continue
        digits, shape = "", []
        for x, b in groups[i:]:
            digits += text[x:b]
            shape.append(b - x)
            if len(digits) > 19:
                break
            if len(digits) < 13:
                continue
            if len(shape) == 1:
                rank = 0
            elif tuple(shape) in CARD_GROUPS:
                # 17 to 19 digits may as well be 16 and something else
                rank = 1 if len(digits) < 17 else 2
            elif whole and (a, b) == (start, end):
                rank = 3
            elif min(shape[:-1]) > 3:
                rank = 4
            else:
                continue
            if digits.strip("0") and not luhn(digits):
                cards.append((rank, a, -b))
    for rank, a, b in sorted(cards):
        # odd groups yield to another value that begins among them
        if rank < 3 or _other(text, a, -b, "card", key) is None:
            return a, -b
    return None


def _iban(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Stretches from ``start`` that may be the IBAN: of its country's length, then all, then (unknown countries) shorter ones."""
    known = IBAN_LENGTHS.get(text[start : start + 2])
    ends = [m.end() + start for m in _TOKEN.finditer(text[start:end])]
    if known:
        yield from ((start, b) for b in ends if b - start - text.count(" ", start, b) == known)
    yield from ((start, b) for b in (ends[-1:] if known else reversed(ends)))


def _phone(text: str, start: int, end: int, key: bytes) -> Iterator[tuple[int, int]]:
    """Stretches from ``start`` that may be the phone number: of its country's length, then up to the next value of another kind."""
    value = text[start:end]
    country = _COUNTRY.match(value)
    decimal = re.fullmatch(r"\+\d+(\.)\d+", value)
    if country is None:
        if not decimal:
            yield start, end
        return
    ends = [m.end() for m in _DIGITS.finditer(value)]
    extra = len(country[1]) + value.startswith("(0)", _trunk(value))
    sizes = {b: sum(map(str.isdigit, value[:b])) for b in ends}
    length = PHONE_LENGTHS.get(country[1])
    yield from ((start, start + b) for b in ends if sizes[b] - extra == length and (not decimal or decimal.start(1) == country.end()))
    if not decimal or decimal.start(1) == country.end() and not length:
        other = _other(text, start + country.end(), end, "phone", key) or end
        yield from ((start, start + b) for b in reversed(ends) if start + b <= other and sizes[b] >= 8)


def replaced(text: str, key: bytes) -> tuple[str, int]:
    """``text`` with pseudonyms, and how many."""
    if not _MAYBE.search(text):
        return text, 0
    out, count = [], 0
    done = at = 0  # text before ``done`` is in ``out``; the search goes on at ``at``
    tried = 0  # end of what was matched but did not validate as a whole
    card = None  # a card number found ahead
    bare = 0  # no card number begins before

    def stretches(kind: str, start: int, end: int) -> Iterator[tuple[int, int]]:
        nonlocal card, bare
        if kind == "iban":
            yield from _iban(text, start, end)
        elif kind == "phone":
            yield from _phone(text, start, end, key)
        elif kind != "card":
            yield start, end
        elif start >= bare:
            card = card or _card(text, start, end, start >= tried and text[start - 1 : start] != "-", key)
            bare = bare if card else end
            if card and card[0] == start:
                yield card

    def values(m: re.Match) -> Iterator[tuple[str, int]]:
        """(pseudonym, end) of what validates at the start of a match, as the kind found and those behind it in PATTERNS."""
        nonlocal tried
        start, kinds = m.start(), list(PATTERNS)
        for kind in kinds[kinds.index(m.lastgroup) :]:
            if m := _KINDS[kind].match(text, start):
                for a, b in stretches(kind, start, m.end()):
                    if (new := pseudonym(kind, text[a:b], key)) is not None:
                        yield new, b
                tried = max(tried, m.end())

    while True:
        m = _ANY.search(text, at)
        if card and (m is None or m.start() >= card[0]):
            start, found = card[0], (pseudonym("card", text[slice(*card)], key), card[1])
        elif m:
            start, found = m.start(), next(values(m), None)
        else:
            break
        if found:
            out += text[done:start], found[0]
            done = at = found[1]
            count += 1
        else:
            at = _TOKEN.match(text, start).end()
        if card and card[0] < at:
            card = None
    out.append(text[done:])
    return "".join(out), count


def pseudonymise(key: str):
    """Column function: text -> struct<text, n_replaced>. A null text stays null, with 0; ``key`` is the secret, not empty."""
    if not key:
        raise ValueError("pseudonyms need a secret key")
    secret = blake2b(key.encode()).digest()

    @F.arrow_udf("struct<text:string,n_replaced:long>")
    def pseudonymise(texts: pa.Array) -> pa.Array:
        rows = [replaced(x.as_py(), secret) if x.is_valid else (None, 0) for x in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["text", "n_replaced"])

    return pseudonymise
