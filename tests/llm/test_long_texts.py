"""Time on texts and pages made to be slow, and values of any length."""

import time

import pytest

from brandweave.llm import html, pii

HARD = {
    "hyphens": "a-", "underscores": "a_", "dots": "a.", "digits": "1234567890", "dotted": "1.", "colons": "1:", "only colons": ":", "spaced": "1 ", "ats": "a@", "hosts": "x@a.", "words": "token ",
    "codes": "AA00 ", "groups": "DE12 3456 7890 ", "plus": "+12 ", "brackets": "(123) ", "months": "Jan 1 ", "phones": "phone me at ", "locals": "a" * 64 + ".",
}


@pytest.mark.parametrize("name", sorted(HARD))
def test_personal_values_take_time_in_proportion(name):
    text = (HARD[name] * 400_000)[:400_000] + " 1"
    took = []
    for part in (text[-100_002:], text):
        began = time.process_time()
        pii.replace(part)
        took.append(time.process_time() - began)
    assert took[1] < max(2.0, 10 * took[0])


def test_long_secrets_keep_their_format_and_stay_apart():
    for value in ("ab12" * 300_000, "aZ9" * 300_000, "aZ9_" * 100):
        new, found = pii.replace(f"my_token = {value} end")
        made = new.removeprefix("my_token = ").removesuffix(" end")
        assert [f[0] for f in found] == ["secret"] and len(made) == len(value) and made != value
        assert all(a == b or (a.isdigit() == b.isdigit() and a.islower() == b.islower()) or "ab12" in value for a, b in zip(made, value, strict=True))
        assert made == pii.replace(f"x-TOKEN: {value}")[0].removeprefix("x-TOKEN: ")
        other = value[:-1] + ("c" if value[-1] != "c" else "d") if not value[-1].isdigit() else value[:-1] + str((int(value[-1]) + 1) % 10)
        assert pii.replace(f"token={other}")[0] != f"token={made}"


def test_short_ipv6():
    for text in ("fe80::1", "at fd00::12.", "2001::7, x"):
        new, found = pii.replace(text)
        assert [f[0] for f in found] == ["ipv6"] and new != text
    for text in ("::1", "dead::1", "12:30:45", "a::b1", "std::2x"):
        assert pii.replace(text) == (text, [])


UNFINISHED = ("<a ", "</a ", "<!", "<?", "<![", "<!--", "&#", "&amp", '<a b="', "<a b='", "<a =", "<!DOCTYPE ", "</", "<a/", "<a b=c ", "<p><script>", "<title>", "<textarea>", "<svg ", "<![CDATA[", "<script ", "</script ", "<!-- -")


@pytest.mark.parametrize("end", ["", ">", '">x', "-->"])
def test_unfinished_markup_takes_time_in_proportion(end):
    for piece in UNFINISHED:
        took = []
        for n in (25_000, 100_000):
            page = "<p>hello</p>" + (piece * n)[:n] + end
            began = time.process_time()
            assert html.main_text(page).startswith("hello")
            took.append(time.process_time() - began)
        assert took[1] < max(1.0, 12 * took[0]), piece


def test_unfinished_markup_takes_the_rest_of_the_page():
    for rest in ("<a href=x y", "<![CDATA[ z", "<?php x", "<!doctype", "</p", "<!-- x"):
        assert html.main_text(f"<p>one</p><p>two</p>{rest}") == "one\ntwo"
    assert html.main_text("<![endif]><p>a < b</p><![if x]><p>c <3</p>") == "a < b\nc <3"
    assert html.main_text("<p>one</p>two < three") == "one\ntwo < three"
