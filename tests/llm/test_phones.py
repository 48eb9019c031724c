"""Phone numbers whose area code or exchange begins with 0 or 1."""

import re

import pytest

from gramloom.llm import pii

FOUND = ["+1 (017) 555-7713", "+1 (132) 555-1352", "+1 (368) 155-0098", "(017) 555-7713", "+1 017-555-7713", "+1.132.555.1352", "017-555-7713", "1 132 055 1352", "017.155.7713"]
LEFT = ["017555-7713", "a017-555-7713", "017-555-77131", "17-555-7713", "2017-155-7713"]


@pytest.mark.parametrize("value", FOUND)
def test_any_area_code(value):
    text = f"call {value}, or {value}."
    out, spans = pii.replace_all(text)
    assert [s[0] for s in spans] == ["phone", "phone"] and value not in out and [text[a:b] for _, a, b in spans] == [value] * 2
    assert re.sub("[0-9]", "0", out) == re.sub("[0-9]", "0", text)
    digits = re.sub("[^0-9]", "", out[5 : 5 + len(value)])[-10:]
    assert digits[0] < "2" or digits[3] < "2"
    assert pii.replace_all(out, invert=True)[0] == text


@pytest.mark.parametrize("value", LEFT)
def test_other_digits_stay(value):
    assert pii.replace_all(f"no {value} here") == (f"no {value} here", [])


def test_card_after_short_groups():
    out, spans = pii.replace_all("123 456 4111 1111 1111 1111")
    assert [s[0] for s in spans] == ["card"] and out.startswith("123 456 4")


def test_planted_form_is_whole():
    numbers = [f"+1 ({a:03d}) 555-{(a * 37) % 10000:04d}" for a in range(1000)]
    out = [pii.replace_all(f"x {n} y")[0] for n in numbers]
    assert not any(n in o for n, o in zip(numbers, out, strict=True)) and len(set(out)) == 1000
    assert [pii.replace_all(o, invert=True)[0] for o in out] == [f"x {n} y" for n in numbers]
