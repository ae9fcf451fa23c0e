"""Personal values planted at known places: found exactly there, replaced by valid values of the same format, undone by nothing else."""

import datetime
import ipaddress
import random
import re

import pytest

from brandweave.llm import pii

FILLER = "lorem ipsum dolor sit amet, consectetur adipiscing elit; sed (do) eiusmod tempor. Incididunt ut labore et dolore magna aliqua!".split()


def luhn(body):
    """The check digit, from the definition: every second digit from the right, doubled, digits added up."""
    for check in range(10):
        digits = [int(c) for c in f"{body}{check}"][::-1]
        if sum(sum(map(int, str(2 * d))) if i % 2 else d for i, d in enumerate(digits)) % 10 == 0:
            return str(check)


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def card(draw):
    body = draw.choice(["4", "51", "55"]) + "".join(draw.choice("0123456789") for _ in range(14))
    number = body[:15] + luhn(body[:15])
    return draw.choice(["", " ", "-"]).join(number[i : i + 4] for i in range(0, 16, 4))


def iban(draw):
    body = "".join(draw.choice("0123456789") for _ in range(18))
    check = next(c for c in range(2, 99) if mod97(f"DE{c:02d}{body}") == 1)
    whole = f"DE{check:02d}{body}"
    return draw.choice([whole, " ".join(whole[i : i + 4] for i in range(0, 22, 4))])


def date(draw):
    day = datetime.date(1950, 1, 1) + datetime.timedelta(draw.randrange(25_000))
    return day.strftime(draw.choice(["%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%B %d, %Y", "%d %B %Y"]))


def ipv4(draw):
    return ".".join(str(draw.choice([8, 77, 100, 200])) if i == 0 else str(draw.randrange(256)) for i in range(4))


PLANTED = {
    "email": lambda draw: f"{draw.choice(['ann', 'bob.x', 'c_d+e'])}{draw.randrange(99)}@{draw.choice(['mail.example.com', 'uni-x.de'])}",
    "card": card,
    "iban": iban,
    "ssn": lambda draw: f"{draw.choice([1, 123, 665, 899]):03d}-{draw.randrange(1, 100):02d}-{draw.randrange(1, 10_000):04d}",
    "ipv4": ipv4,
    "ipv6": lambda draw: str(ipaddress.IPv6Address((0x2001 << 112) + draw.getrandbits(112))),
    "phone": lambda draw: draw.choice(["+1 {}-{}-{}", "({}) {}-{}", "{}-{}-{}"]).format(draw.randrange(200, 1000), draw.randrange(200, 1000), f"{draw.randrange(10_000):04d}"),
    "date": date,
    "secret": lambda draw: f"api_key={draw.getrandbits(128):032x}",
}


def valid(kind, text):
    """Whether a value is one of its kind, by the kind's own rules."""
    digits = re.sub(r"\D", "", text)
    if kind == "card":
        return luhn(digits[:-1]) == digits[-1]
    if kind == "iban":
        return mod97(text.replace(" ", "")) == 1
    if kind == "ssn":
        return text[:3] not in ("000", "666") and text[0] != "9" and text[4:6] != "00" and text[7:] != "0000"
    if kind in ("ipv4", "ipv6"):
        return str(ipaddress.ip_address(text)) == text
    if kind == "email":
        return re.fullmatch(r"[a-z0-9._+]+@[a-z0-9-]+(\.[a-z0-9-]+)*\.(com|de)", text) is not None
    if kind == "date":
        return any(_parsed(text, f) for f in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y", "%B %d, %Y", "%d %B %Y"))
    return True


def _parsed(text, form):
    try:
        return bool(datetime.datetime.strptime(text, form))
    except ValueError:
        return False


@pytest.mark.parametrize("seed", range(6))
def test_planted_values_are_found_where_they_stand(seed):
    draw = random.Random(seed)
    for _ in range(60):
        text, want = "", []
        for _ in range(draw.randint(0, 9)):
            text += " ".join(draw.choices(FILLER, k=draw.randint(1, 6))) + draw.choice([" ", "\n", " – ", " é "])
            kind = draw.choice(sorted(PLANTED))
            value = PLANTED[kind](draw)
            want.append((kind, len(text), value))
            text += value + draw.choice([" ", "\n", ", ", ". "])
        text += "Dolor."
        new, found = pii.replace(text)
        assert [(k, text[s : s + n]) for k, s, n in found] == [(k, v) for k, _, v in want]
        assert [s for _, s, _ in found] == [s for _, s, _ in want]
        # what lies between the values is as it was, and every pseudonym is a valid value of its kind
        rest, at = new, 0
        for kind, start, value in want:
            between = text[at:start]
            assert rest.startswith(between)
            rest, at = rest[len(between) :], start + len(value)
            end = rest.index(text[at : at + 1]) if kind in ("email", "ipv4", "ipv6") else None
            made = rest[: end if end is not None else len(value)] if kind != "date" or value[:4].isdigit() or value[2] in "./" else None
            if kind in ("email", "ipv4", "ipv6"):
                made = re.match(r"\S+?(?=[,.]?\s)", rest)[0]
            if made is None:
                made = re.match(r"(?:\w+ \d{2}, \d{4}|\d{2} \w+ \d{4})", rest)[0]
            assert made != value and valid(kind, made), (kind, value, made)
            assert [k for k, *_ in pii.replace(f"x {made} y")[1]] == [kind]
            rest = rest[len(made) :]
        assert rest == text[at:]
