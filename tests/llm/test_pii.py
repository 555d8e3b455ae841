import datetime as dt
import random
import re

import pytest
from oddities import BASE, documents, empty, odd

from loomlog.llm import pii

VALUES = {
    "email": ["jane.doe+x@mail.example.com", "A1@b-c.org"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    "ipv4": ["152.143.123.131", "0.0.0.0"],
    "iso_date": ["1999-12-31", "2000/02/29"],
    "date": ["31/12/1999", "12/31/1999", "01.02.2003"],
    "ssn": ["078-05-1120", "899 99 9999"],
    "card": ["4785380592391139", "4111 1111 1111 1111", "378282246310005"],
    "phone": ["+1 (736) 555-2678", "736-555-2678"],
    "e164": ["+49 151 2345678"],
}
INVALID = ["4785380592391138", "999.1.1.1", "01.2.3.4", "1.2.3.4.5", "2001-02-30", "32/13/1999", "000-12-3456", "666-12-3456", "123-00-1234", "GB83 WEST 1234 5698 7654 32", "x4785380592391139", "deadbeef4785380592391139aa", "(136) 555-2678", "user@", "version 3.11"]


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in VALUES.items() for v in vs])
def test_format_validity_and_way_back(kind, value):
    forth, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", back=True)
    text = f"before {value}, after; {value}."
    new, spans = forth.replace(text)
    assert [(k, text[s:e]) for k, s, e in spans] == [(kind, value)] * 2
    assert value not in new and len(new) == len(text) or kind in ("ipv4",)
    assert back.replace(new)[0] == text
    again, found = forth.replace(new)
    assert [k for k, _, _ in found] == [kind] * 2  # what comes out is valid in the same format
    assert pii.Pseudonyms(b"other").replace(text)[0] != new
    assert new.count(new[7 : new.index(", after")]) == 2  # equal values stay equal


@pytest.mark.parametrize("text", [*INVALID, "plain words", "", "é" * 10])
def test_what_is_not_valid_stays(text):
    assert pii.Pseudonyms(b"key").replace(f"a {text} b")[0] == f"a {text} b"


@pytest.mark.parametrize("text", ["." * 300_000 + "1", "a." * 150_000 + "1", "1-" * 150_000, "+1 " * 100_000, "AB12 " * 60_000, "@" * 200_000])
def test_long_runs_take_no_longer_than_their_length(text):
    import time

    start = time.process_time()
    assert pii.Pseudonyms(b"key").replace(text)[0] == text
    assert time.process_time() - start < 5


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(n):
    f = pii.Feistel(n, b"k", "t")
    moved = [f.move(x) for x in range(n)]
    assert sorted(moved) == list(range(n)) and [f.move(x, back=True) for x in moved] == list(range(n))
    assert n == 1 or all(x != y for x, y in enumerate(moved))


def test_different_values_stay_different():
    p = pii.Pseudonyms(b"key")
    dates = [f"{d:02d}/{m:02d}/2024" for d in range(1, 29) for m in range(1, 13)]
    assert len({p.replace(d)[0] for d in dates}) == len(dates)


def test_tables(spark):
    rows = pii.pseudonymise(documents(spark, [(1, "mail a.b@c.example.com now"), (2, "a.b@c.example.com"), (3, None)])).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["text"] == f"mail {by[2]['text']} now" and by[3]["text"] is None and by[3]["pii"] == []
    got = pii.pseudonymise(odd(spark)).collect()
    assert sorted((r["text"] or "") for r in got) == sorted((t or "") for _, t, *_ in BASE)  # nothing in them is a valid value
    assert pii.with_counts(pii.pseudonymise(empty(spark))).collect() == []
    back = pii.pseudonymise(pii.pseudonymise(documents(spark, [(1, "a 152.143.123.131 b")]), b"k"), b"k", back=True)
    assert back.first()["text"] == "a 152.143.123.131 b"


@pytest.mark.parametrize(("text", "value"), [("ES91 2100 0418 4502 0005 1332 BIC", "ES91 2100 0418 4502 0005 1332"), ("AT611904300234573201 I think", "AT611904300234573201"), ("BE68 5390 0754 7034 2024-01-01", "BE68 5390 0754 7034"), ("AB12 4111 1111 1111 1111", "4111 1111 1111 1111")])
def test_values_beside_other_words_are_found(text, value):
    new, spans = pii.Pseudonyms(b"key").replace(text)
    assert value in [text[s:e] for _, s, e in spans] and value not in new
    assert pii.Pseudonyms(b"key", back=True).replace(new)[0] == text


def test_equal_dates_and_numbers_are_linked_in_any_notation():
    new = lambda t: pii.Pseudonyms(b"key").replace(t)[0]
    y, m, d = new("1999-12-31").split("-")
    assert new("31/12/1999") == f"{d}/{m}/{y}" and new("1999/12/31") == f"{y}/{m}/{d}"
    digits = lambda t: re.sub("[^0-9]", "", t)
    assert digits(new("+17365552678")) == digits(new("+1 (736) 555-2678")) == "1" + digits(new("736-555-2678"))
    assert new("+11365552678") == "+11365552678"  # no area code begins with 1
    assert pii.Pseudonyms(b"key", back=True).replace(new("+17365552678"))[0] == "+17365552678"


def _valid(kind, s):
    """Each format's rule once more, by other means."""
    d = re.sub("[^0-9]", "", s)
    if kind == "ipv4":
        return all(str(int(p)) == p and int(p) < 256 for p in s.split("."))
    if kind in ("iso_date", "date"):
        orders = ["%Y%m%d"] if kind == "iso_date" else ["%d%m%Y", "%m%d%Y"]
        for order in orders:
            try:
                if 1900 <= dt.datetime.strptime(d, order).year < 2100:
                    return True
            except ValueError:
                pass
        return False
    if kind == "ssn":
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    if kind == "phone":
        return d[-10] in "23456789" and d[-7] in "23456789"
    return False


SHAPES = {
    "ipv4": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "iso_date": r"\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d{4}\.\d\d\.\d\d", "date": r"\d\d-\d\d-\d{4}|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4}",
    "ssn": r"\d{3}-\d\d-\d{4}|\d{3} \d\d \d{4}", "phone": r"\d{3}[-. ]\d{3}[-. ]\d{4}",
}


def brute_detect(text):
    """Tries every substring at every place: the first kind with a valid one wins, then the search goes on behind it."""
    spans, at = [], 0
    while at < len(text):
        end = None
        if at == 0 or not text[at - 1].isalnum():
            for kind, shape in SHAPES.items():
                for stop in range(min(len(text), at + 16), at, -1):
                    alone = stop == len(text) or not text[stop].isalnum()
                    if kind == "ipv4":
                        alone = alone and not re.match(r"\.\d", text[stop:]) and not re.search(r"\d\.$", text[:at])
                    if alone and re.fullmatch(shape, text[at:stop], re.A) and _valid(kind, text[at:stop]):
                        spans.append((kind, at, stop))
                        end = stop
                        break
                if end:
                    break
        at = end or at + 1
    return spans


@pytest.mark.parametrize("seed", range(400))
def test_spans_equal_trying_every_substring(seed):
    rng = random.Random(seed)
    part = lambda *n: "".join(rng.choice("0123456789") for _ in range(rng.choice(n)))
    shape = lambda: rng.choice([
        ".".join(str(rng.randrange(300)) for _ in range(rng.choice([3, 4, 4, 5]))), f"{rng.choice([1899, 1999, 2024])}-{rng.randrange(14):02d}-{rng.randrange(33):02d}", f"{rng.randrange(33):02d}/{rng.randrange(14):02d}/{rng.choice([1999, 2100])}",
        f"{rng.choice(['000', '666', '900', '123'])}-{rng.choice(['00', '45'])}-{rng.choice(['0000', '6789'])}", f"{part(3)}-{part(3)}-{part(4)}", part(1, 2, 3), "a", "x1",
    ])
    text = "".join(shape() + rng.choice([" ", ", ", ". ", "a", "/", "-"]) for _ in range(12))
    assert pii.Pseudonyms(b"key").replace(text)[1] == brute_detect(text)


def luhn(body):
    return next(c for c in "0123456789" if sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(body + c))) % 10 == 0)


@pytest.mark.parametrize("seed", range(40))
def test_planted_cards_and_accounts_are_found_and_wrong_ones_left(seed):
    rng = random.Random(seed)
    text, want = "", []
    for _ in range(10):
        body = rng.choice("23456") + "".join(rng.choices("0123456789", k=14))
        right = luhn(body)
        digits = body + rng.choice([right, str((int(right) + 1) % 10)])
        if rng.random() < 0.5:
            bban = "".join(rng.choices("0123456789", k=18))
            check = 98 - int(bban + "131400") % 97
            digits = f"DE{(check + rng.choice([0, 1])) % 100:02d}{bban}"
            good = int(bban + "1314" + digits[2:4]) % 97 == 1
        else:
            good = digits[-1] == right
        text += rng.choice(["", "card ", "to ", "é"][:3]) + " "
        if good:
            want.append((len(text), len(text) + len(digits)))
        text += digits + rng.choice([" ", ", ", ".\n"]) + rng.choice(["and", "then;"])
    assert [(s, e) for _, s, e in pii.Pseudonyms(b"key").replace(text)[1]] == want
