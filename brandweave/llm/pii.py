"""Format-preserving pseudonyms for personal data.

Personal values are found by pattern and checked (Luhn, mod 97, octets, area codes, calendar), then
permuted by a keyed Feistel network within the values of the same format: a card number becomes
another valid card number of its length, a date another date in its notation. The permutation
depends on the kind of value alone, so equal values, however they are punctuated, have equal
pseudonyms in all documents, and different values different ones. Who holds the key can undo it.
Where a format has values of several classes (public and other addresses, phone numbers that exist
and others, days up to the 12th and later ones, by which notations are told apart), each class is
permuted by itself, so the whole stays a permutation; the class is all that shows.

Dates have a day, a month in digits or by its English, German, French or Spanish name, and a year;
two-digit years stand for 1930 to 2029 and are permuted among themselves, those that stand first
(84-05-03) apart from the others. A time after a date stays. Phone numbers have separators, a plus or
a leading 0; ten digits without any are one where a word such as phone or call stands before them.

Of IPv6 addresses, those with fewer than three colons are one where they start like a global, unique or
link-local one (``fe80::1``); ``::1`` and the like stay.

The pattern takes time in proportion to the text: all its repeats are bounded, or end where they
began to match, and values of any length are permuted in pieces. Values are replaced inside the tasks that read the texts; nothing is shuffled or gathered.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brandweave.llm.common import small_batches, table, tidy

#: For tests and the registered query; give your own key in production.
DEMO_KEY = b"brandweave demonstration key"
ROUNDS = 8
FOUND = T.StructField("found", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])))
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _rounds(value: int, bits: int, key: bytes, kind: str, undo: bool) -> int:
    """A balanced Feistel network on values of 2 * bits bits."""
    mask = (1 << bits) - 1
    left, right = value >> bits, value & mask
    size = (bits + 7) // 8
    for r in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        data = left if undo else right
        seed = hashlib.blake2b(b"%d:" % r + kind.encode() + b":" + data.to_bytes(size, "big"), key=key, digest_size=16).digest()
        mixed = int.from_bytes(hashlib.shake_128(seed).digest(size) if size > 16 else seed[:size], "big") & mask
        left, right = (right ^ mixed, left) if undo else (right, left ^ mixed)
    return left << bits | right


def permute(value: int, n: int, key: bytes, kind: str, side: Callable[[int], object] | None = None, undo: bool = False) -> int:
    """The value's place under a keyed permutation of 0 .. n-1.

    The network covers the next power of four; results outside 0 .. n-1, or of another class by
    ``side``, are permuted again (cycle walking), which is a permutation of each class.
    """
    if n < 2:
        return value
    bits = ((n - 1).bit_length() + 1) // 2
    own = side(value) if side else None
    while True:
        value = _rounds(value, bits, key, kind, undo)
        if value < n and (side is None or side(value) == own):
            return value


def luhn_digit(body: str) -> str:
    """The check digit that completes a number."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _fill(pattern: str, digits: str) -> str:
    """The pattern with its digits replaced one by one."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in pattern)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


#: Letters and digits that are permuted as one number; longer texts are permuted piece by piece.
PIECE = 256


def _spelled(text: str, key: bytes, kind: str, side: Callable[[str], object] | None = None) -> str:
    """Permutes the letters and digits of a text within their kinds, as one mixed-radix number."""
    if len(text) > PIECE:
        return "".join(_spelled(text[i : i + PIECE], key, f"{kind}@{i}", side) for i in range(0, len(text), PIECE))
    radix = [(10, "0") if c.isdigit() else (26, "a") if c.islower() else (26, "A") if c.isupper() else None for c in text]
    radix = [r if r and c.isascii() else None for r, c in zip(radix, text, strict=True)]
    value, n = 0, 1
    for r, c in zip(radix, text, strict=True):
        if r:
            value, n = value * r[0] + ord(c) - ord(r[1]), n * r[0]

    def spell(value: int) -> str:
        out = []
        for r, c in zip(reversed(radix), reversed(text), strict=True):
            if r:
                value, d = divmod(value, r[0])
                c = chr(ord(r[1]) + d)
            out.append(c)
        return "".join(reversed(out))

    kind = f"{kind}:{''.join(r[1] if r else c for r, c in zip(radix, text, strict=True))}"
    return spell(permute(value, n, key, kind, (lambda v: side(spell(v))) if side else None))


def _email(m: re.Match, key: bytes) -> str | None:
    local, _, domain = m["email"].lower().partition("@")
    host, _, top = domain.rpartition(".")
    return f"{_spelled(local, key, 'email')}@{_spelled(host, key, 'host')}.{top}"


def _card(m: re.Match, key: bytes) -> str | None:
    digits = _digits(m["card"])
    if not 12 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    width = len(digits) - 1
    same = lambda n: n % 10 * (10**width - 1) // 9 == n  # noqa: E731  one digit throughout, which is no card
    body = f"{permute(int(digits[:-1]), 10**width, key, f'card{len(digits)}', same):0{width}d}"
    return _fill(m["card"], body + luhn_digit(body))


def _area(n: int) -> bool:
    """Area code and exchange of a North American number start from 2."""
    return n // 10**9 >= 2 and n // 10**6 % 10 >= 2


def _phone(m: re.Match, key: bytes) -> str | None:
    text = m["phone"]
    digits = _digits(text)
    if len(digits) == 11 and digits[0] == "1" or len(digits) == 10 and not text.startswith(("+", "0")):
        head, body = digits[:-10], digits[-10:]
        return _fill(text, head + f"{permute(int(body), 10**10, key, 'phone10', _area):010d}")
    if text.startswith("0"):
        if not 9 <= len(digits) <= 12:
            return None
        first = lambda n: n // 10 ** (len(digits) - 2) > 0  # noqa: E731  no second 0
        return _fill(text, "0" + f"{permute(int(digits[1:]), 10 ** (len(digits) - 1), key, f'phone0{len(digits)}', first):0{len(digits) - 1}d}")
    if text.startswith("+") and 8 <= len(digits) <= 15:
        head = _digits(re.match(r"\+\d{1,3}", text)[0])[:2]
        body = digits[len(head) :]
        return _fill(text, head + f"{permute(int(body), 10 ** len(body), key, 'phone' + head + str(len(body))):0{len(body)}d}")
    return None


def _called(m: re.Match, key: bytes) -> str | None:
    """Ten digits after a word that announces a phone number."""
    whole, number = m["called"], m["number"]
    if not _area(int(number)):
        return None
    return whole[: -len(number)] + f"{permute(int(number), 10**10, key, 'phone10', _area):010d}"


def _unicast(n: int) -> bool:
    return 1 <= n >> 24 <= 223 and n >> 24 not in (10, 127)


def _ipv4(m: re.Match, key: bytes) -> str | None:
    parts = [int(p) for p in m["ipv4"].split(".")]
    if max(parts) > 255:
        return None
    return str(ipaddress.IPv4Address(permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ipv4", _unicast)))


#: How an address of few groups starts: unique and link-local, and global ones.
SHORT_IPV6 = re.compile(r"(?:[Ff][CcDd][0-9A-Fa-f]{2}|[Ff][Ee]80|[23][0-9A-Fa-f]{3})::")


def _ipv6(m: re.Match, key: bytes) -> str | None:
    if m["ipv6"].count(":") < 3 and not SHORT_IPV6.match(m["ipv6"]) or not any(c.isdigit() for c in m["ipv6"]):
        return None
    try:
        value = int(ipaddress.IPv6Address(m["ipv6"]))
    except ValueError:
        return None
    return str(ipaddress.IPv6Address(permute(value, 1 << 128, key, "ipv6", lambda n: n > 1))) if value > 1 else None


def _social(n: int) -> bool:
    area, group, serial = n // 10**6, n // 10**4 % 100, n % 10**4
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _ssn(m: re.Match, key: bytes) -> str | None:
    value = int(_digits(m["ssn"]))
    return _fill(m["ssn"], f"{permute(value, 10**9, key, 'ssn', _social):09d}") if _social(value) else None


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    n: frozenset(codes.split())
    for n, codes in {
        15: "NO", 16: "BE BI", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BF BJ CI CM FR GR IT MC MG ML MR SM SN", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}


def _iban_ends(text: str, start: int) -> list[int]:
    """Where an IBAN may end whose pattern has taken this text: the end by its country's length first,
    then the ends of its groups, the last first."""
    ends = [i for i in range(len(text), 0, -1) if i == len(text) or text[i] == " "]
    own = next((n for n, codes in IBAN_LENGTHS.items() if text[:2] in codes), 0)
    return [start + i for i in sorted(ends, key=lambda i: i - text.count(" ", 0, i) != own)]


def _iban(m: re.Match, key: bytes) -> str | None:
    raw = m["iban"].replace(" ", "").upper()
    if not 15 <= len(raw) <= 34 or _mod97(raw[4:] + raw[:4]) != 1:
        return None
    body = _spelled(raw[4:], key, "iban" + raw[:2])
    made = iter(raw[:2] + f"{98 - _mod97(body + raw[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(made) for c in m["iban"])


#: Full and short month names; alternatives are read, the first is written.
MONTHS = {
    "en": ("January February March April May June July August September October November December", "Jan Feb Mar Apr May Jun Jul Aug Sep|Sept Oct Nov Dec"),
    "de": ("Januar|J\u00e4nner Februar M\u00e4rz|Maerz April Mai Juni Juli August September Oktober November Dezember", "Jan Feb M\u00e4r Apr Mai Jun Jul Aug Sep|Sept Okt Nov Dez"),
    "fr": ("janvier f\u00e9vrier|fevrier mars avril mai juin juillet ao\u00fbt|aout septembre octobre novembre d\u00e9cembre|decembre", "janv f\u00e9vr|fevr mars avr mai juin juil ao\u00fbt sept oct nov d\u00e9c"),
    "es": ("enero febrero marzo abril mayo junio julio agosto septiembre|setiembre octubre noviembre diciembre", "ene feb mar abr may jun jul ago sep|sept oct nov dic"),
}
#: By language, for full and short names: the names written, and the month of each name read.
_NAMES = {
    language: [([month.split("|")[0] for month in names.split()], {name.lower(): i + 1 for i, month in enumerate(names.split()) for name in month.split("|")}) for names in both]
    for language, both in MONTHS.items()
}
_MONTH = "(?i:" + "|".join(sorted({name for both in _NAMES.values() for _, read in both for name in read}, key=lambda x: (-len(x), x))) + ")"
_DAY = r"\d{1,2}(?:st|nd|rd|th|er|\u00ba|\.)?"
_YEAR = r"(?:\d{4}|['\u2019]\d{2})"
#: Day, month's name and year in their usual orders.
DAY_FIRST = rf"{_DAY}(?:[ ](?:of[ ]|de[ ])?{_MONTH}\.?,?[ ](?:del?[ ])?{_YEAR}|-{_MONTH}-(?:\d{{4}}|\d{{2}}))"
MONTH_FIRST = rf"{_MONTH}\.?[ ]{_DAY},?[ ]{_YEAR}"
YEAR_FIRST = rf"\d{{4}}[ -]{_MONTH}[ -]\d{{1,2}}"
#: A year of two digits is one of these hundred.
FIRST_SHORT, LAST_SHORT = datetime.date(1930, 1, 1).toordinal(), datetime.date(2029, 12, 31).toordinal()


def _year(text: str) -> int:
    year = int(text)
    return year if len(text) != 2 else year + (1900 if year >= 30 else 2000)


def _late(day: datetime.date) -> bool:
    """Whether a day can't be taken for a month, so that its place in a date is plain."""
    return day.day > 12


def _new_day(day: int, short: bool, key: bytes, side: Callable[[datetime.date], object] = _late) -> datetime.date | None:
    """The day that takes a day's place, among those that years of four or two digits can name."""
    first, last, kind = (FIRST_SHORT, LAST_SHORT, "date2") if short else (FIRST_DAY, LAST_DAY, "date")
    if not first <= day <= last:
        return None
    return datetime.date.fromordinal(first + permute(day - first, last - first + 1, key, kind, lambda n: side(datetime.date.fromordinal(first + n))))


def _read(order: str, parts: tuple[str, ...]) -> int | None:
    named = dict(zip(order, parts, strict=True))
    try:
        return datetime.date(_year(named["y"]), int(named["m"]), int(named["d"])).toordinal()
    except ValueError:
        return None


def _date(m: re.Match, key: bytes) -> str | None:
    if m["d1"] is None:
        return _named_date(m["date"], key)
    a, sep, b, c = m["d1"], m["ds"], m["d2"], m["d3"]
    short = max(len(a), len(c)) < 4
    orders = ("ymd",) if len(a) == 4 else ("dmy", "mdy") if sep == "." else ("mdy", "dmy")
    if short:
        # A year has two digits, so that versions and the like are not dates.
        orders = tuple(o for o in (*orders, *(("ymd",) if sep != "." else ())) if len((a, b, c)[o.index("y")]) == 2)
    for k, order in enumerate(orders):
        if (day := _read(order, (a, b, c))) is None:
            continue
        width = {x: len(v) if v[0] == "0" or len(v) > 1 else 1 for x, v in zip(order, (a, b, c), strict=True)}
        spell = lambda new: tuple(f"{ {'y': new.year % 100 if short else new.year, 'm': new.month, 'd': new.day}[x]:0{width[x]}d}" for x in order)  # noqa: B023, E731
        # Days up to the 12th and later ones stay apart, so the new date is read in the same order. A
        # short year in front stays one that can't be read as a day or a month.
        side = (lambda new: all(_read(o, spell(new)) is None for o in orders[:k])) if short and order == "ymd" else _late  # noqa: B023
        new = _new_day(day, short, key, side)
        return None if new is None else sep.join(spell(new))
    return None


def _named_date(text: str, key: bytes) -> str | None:
    """A date with a month's name, which keeps its language, length and case."""
    name = re.search(rf"(?<![^\W\d_]){_MONTH}(?![^\W\d_])", text)
    numbers = list(re.finditer(r"\d+", text))
    year_at, day_at = (0, 1) if len(numbers[0][0]) == 4 else (1, 0)
    written, year, old = name[0], numbers[year_at][0], numbers[day_at]
    languages = ("de", "en", "fr", "es") if text[old.end() : old.end() + 1] == "." else ("fr", "es", "en", "de") if written[0].islower() else ("en", "de", "fr", "es")
    if re.search(r"\bdel?\b", text):
        languages = ("es", *languages)
    names, month = next((names, read[written.lower()]) for style in (0, 1) for language in languages for names, read in [_NAMES[language][style]] if written.lower() in read)
    short = len(year) == 2
    try:
        day = datetime.date(_year(year), month, int(old[0])).toordinal()
    except ValueError:
        return None
    if (new := _new_day(day, short, key)) is None:
        return None
    spelled = names[new.month - 1]
    spelled = spelled.upper() if written.isupper() and len(written) > 1 else spelled.lower() if written[0].islower() else spelled[0].upper() + spelled[1:]
    ending = re.match(r"st|nd|rd|th|er|", text[old.end() :])[0]
    after = old.end() + len(ending)
    if ending == "er":
        ending = "er" if new.day == 1 else ""
    elif ending:
        ending = "th" if 10 < new.day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
    width = 2 if len(old[0]) == 2 else 1
    parts = [(old.start(), after, f"{new.day:0{width}d}{ending}"), (*name.span(), spelled), (*numbers[year_at].span(), f"{new.year % 100:02d}" if short else str(new.year))]
    for start, end, value in sorted(parts, reverse=True):
        text = text[:start] + value + text[end:]
    return text


HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


def _hex(value: str, key: bytes) -> str:
    """Permutes hexadecimal digits, long runs of them piece by piece."""
    pieces = [value[i : i + PIECE] for i in range(0, len(value), PIECE)]
    kind = lambda i: f"hex{len(value)}" + (f"@{i}" if len(pieces) > 1 else "")
    return "".join(f"{permute(int(p, 16), 16 ** len(p), key, kind(i)):0{len(p)}x}" for i, p in enumerate(pieces))


def _secret(m: re.Match, key: bytes) -> str | None:
    whole, value = m["secret"], m["value"]
    if HEX.fullmatch(value):
        new = _hex(value, key)
        new = new.upper() if value.isupper() else new
    else:
        new = _spelled(value, key, "secret", lambda s: bool(HEX.fullmatch(s)))
    at = m.start("value") - m.start("secret")
    return whole[:at] + new + whole[at + len(value) :]


KINDS: dict[str, Callable[[re.Match, bytes], str | None]] = {
    "secret": _secret, "email": _email, "iban": _iban, "called": _called, "phone": _phone, "card": _card, "ssn": _ssn, "date": _date, "ipv4": _ipv4, "ipv6": _ipv6,
}
PATTERN = re.compile(
    r"""(?P<secret>(?<![^\W_])(?i:api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|token|secret|password|passwd|pwd)["']?\s*[:=]\s*["']?(?P<value>[A-Za-z0-9_+/=.-]{7,}[A-Za-z0-9_+/=]))
    |(?P<email>[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24})
    |(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
    |(?P<called>\b(?i:tele(?:phone|fon|fono)|t\u00e9l\u00e9phone|phones?|tel|t\u00e9l|call(?:ed|s|ing)?|mobile?|m\u00f3vil|cell(?:phone)?|fax|handy|whatsapp|sms|text|ring|dial)\b[.:]?(?:[ ](?:me|us|him|her|them|at|on|no\.?|number|is|under|nr\.?)){0,3}[:#]?[ ]?(?P<number>\d{10})(?![\w-]|\.\d))
    |(?P<phone>(?<![\w+])(?:(?:\+?1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|(?:\+?1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}|\+1\d{10}|\+(?!1[ (.-])\d{2,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}|(?<![./-])(?!\d{4}[ ]\d{4}[ ]\d{4}[ ]\d)0[1-9]\d{0,3}(?:[ /-]\d{6,8}|(?:[ ]\d{2,4}){2,4})(?![-/]\d))(?!\d))
    |(?P<card>(?<!\d)(?:\d{12,19}|\d{4}(?P<c1>[ -])\d{4}(?P=c1)\d{4}(?P=c1)\d{1,7}|\d{4}(?P<c2>[ -])\d{6}(?P=c2)\d{5})(?!\d))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<date>(?<![\w./-])(?:(?<![Vv]ersion[ ])(?<![Rr]elease[ ])(?P<d1>\d{4}|\d{1,2})(?P<ds>[./-])(?P<d2>\d{1,2})(?P=ds)(?P<d3>\d{4}|\d{1,2})(?!(?![Tt]\d\d:?\d\d)[\w/-]|\.\d)|(?:"""
    + f"{YEAR_FIRST}|{DAY_FIRST}|{MONTH_FIRST}"
    + r""")(?!\w)))
    |(?P<ipv4>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w))
    |(?P<ipv6>(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]))""",
    re.VERBOSE,
)
#: A text without any of these holds nothing that the pattern finds.
HINT = re.compile(r"[0-9@]|::|[Kk][Ee][Yy]|[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Pp][Aa][Ss][Ss][Ww]|[Pp][Ww][Dd]")


def replace(text: str, key: bytes = DEMO_KEY) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of what was found, in characters of the
    original text."""
    if not HINT.search(text):
        return text, []
    out, found, at, start = [], [], 0, 0
    while m := PATTERN.search(text, start):
        kind = next(k for k in KINDS if m[k] is not None)
        for end in _iban_ends(m[0], m.start()) if kind == "iban" else (m.end(),):
            new = _pseudonym(kind, text[m.start() : end], key)
            if new is not None:
                out += [text[at : m.start()], new]
                at = start = end
                found.append((kind, m.start(), end - m.start()))
                break
        else:
            # What failed its check may hold other values.
            start = m.start() + 1
    return ("".join(out) + text[at:] if found else text), found


@lru_cache(maxsize=10_000)
def _pseudonym(kind: str, value: str, key: bytes) -> str | None:
    m = next((m for m in PATTERN.finditer(value) if m[kind] is not None), None)
    return None if m is None or m[0] != value else KINDS[kind](m, key)


def pseudonymise(documents: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """``row``, the document with its text replaced, and ``found``.

    A null text stays null and holds nothing. All other columns, whatever their names, are as they
    were. Repeated rows give repeated results.
    """
    if len(key) > 64:
        raise ValueError("a key has at most 64 bytes")
    rows = small_batches(documents).select(F.struct("*").alias("row"))
    at = documents.columns.index("text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            columns = row.flatten()
            done = [(None, []) if t is None else replace(t, key) for t in columns[at].to_pylist()]
            columns[at] = pa.array([t for t, _ in done], type=row.type.field(at).type)
            made = pa.StructArray.from_arrays(columns, fields=list(row.type))
            found = pa.array([[dict(zip(("kind", "start", "length"), x, strict=True)) for x in f] for _, f in done], type=kind)
            yield pa.RecordBatch.from_arrays([made, found], names=["row", "found"])
        _pseudonym.cache_clear()  # workers live on, for other stages

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema, FOUND]))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and what was replaced."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "row.text", F.size("found").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("found.kind")), ",").alias("kinds"))
