import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowkit.llm import pii

KEY = b"k" * 32


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 3000))
def test_permutation(size):
    assert sorted(pii.permute(x, size, KEY, "t") for x in range(min(size, 200))) == sorted({pii.permute(x, size, KEY, "t") for x in range(min(size, 200))})
    if size <= 200:
        assert {pii.permute(x, size, KEY, "t") for x in range(size)} == set(range(size))


CASES = {
    "mail ana.45@mail7.example.com now": "email",
    "card 4111 1111 1111 1111 ok": "card",
    "call +1 (017) 555-7713 today": "phone",
    "host 97.51.17.173 up": "ip",
    "born 1984-02-29.": "date",
    "on 31/12/1999 at": "date",
    "on 12/31/1999 at": "date",
    "am 24.12.2001 um": "date",
    "ssn 123-45-6789 x": "ssn",
    "iban GB82 WEST 1234 5698 7654 32 x": "iban",
}


@pytest.mark.parametrize("text", CASES)
def test_formats_are_kept(text):
    new, n = pii.replaced(text, KEY)
    m = pii._ANY.search(text)
    assert n == 1 and new != text and len(new.split()) == len(text.split()) and m.lastgroup == CASES[text]
    again = pii._ANY.search(new)
    assert again and again.lastgroup == m.lastgroup and pii.pseudonym(again.lastgroup, again[0], KEY)
    assert pii.replaced(text, KEY) == (new, 1) and pii.replaced(text, b"other" * 7)[0] != new


def test_validity_and_links():
    new = pii.replaced("4111-1111-1111-1111 4111111111111111", KEY)[0].split()
    assert new[0].replace("-", "") == new[1] and pii.luhn(new[1]) == 0
    a = pii.replaced("Ana.45@Example.com", KEY)[0]
    assert a.lower() == pii.replaced("ana.45@example.com", KEY)[0] and a[0].isupper() and a.endswith(".com")
    day = pii.replaced("2020-02-03", KEY)[0]
    assert datetime.date.fromisoformat(day) and pii.replaced("03.02.2020", KEY)[0] == datetime.date.fromisoformat(day).strftime("%d.%m.%Y")
    d = pii.replaced("12/31/1999", KEY)[0]
    assert pii._ANY.fullmatch(d)


def test_what_does_not_validate_stays():
    for text in ("4111111111111112", "999.1.1.1", "2021-02-30", "000-12-3456", "GB00 WEST 1234 5698 7654 32", "v1.2.3.4.5", "9807915762804491", "no digits", "1234567", "3.14"):
        assert pii.replaced(text, KEY) == (text, 0)


CARD, AMEX, IBAN = "4539578763621486", "378282246310005", "DE89370400440532013000"


@pytest.mark.parametrize(
    "text, values",
    [
        (f"{CARD} 97.51.17.173", [CARD, "97.51.17.173"]),
        (f"97.51.17.173 {CARD}", [CARD, "97.51.17.173"]),
        (f"7 {CARD}", [CARD]),
        (f"7-{CARD}", [CARD]),
        (f"2024-{CARD}", [CARD]),
        (f"1234 {CARD}", [CARD]),
        ("4111 1111 1111 1111 12/27", ["4111 1111 1111 1111"]),
        ("12/27 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
        ("4111-1111-1111-1111 123", ["4111-1111-1111-1111"]),
        ("1 2 3 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
        ("3782 822463 10005 1234", ["3782 822463 10005"]),
        (f"{AMEX} 2020-02-03", [AMEX, "2020-02-03"]),
        (f"{CARD} {AMEX} 5500 0000 0000 0004", [CARD, AMEX, "5500 0000 0000 0004"]),
        ("7 123-45-6789 4111 1111 1111 1111", ["123-45-6789", "4111 1111 1111 1111"]),
        ("2021-02-30 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
        (f"{IBAN} {CARD}", [IBAN, CARD]),
        (f"{IBAN} 12 AB", [IBAN]),
        ("GB82 WEST 1234 5698 7654 32 VISA 4111 1111 1111 1111", ["GB82 WEST 1234 5698 7654 32", "4111 1111 1111 1111"]),
        (f"AB12 {IBAN}", [IBAN]),
        (f"AB12 {CARD}", [CARD]),
    ],
)
def test_values_next_to_others(text, values):
    wanted = text
    for v in values:
        wanted = wanted.replace(v, pii.replaced(v, KEY)[0])
    assert pii.replaced(text, KEY) == (wanted, len(values)) and not any(v in wanted for v in values)


def test_phones_link_however_written():
    def national(text, code, trunk=""):
        new, n = pii.replaced(text, KEY)
        kept = code + trunk
        digits = "".join(c for c in new if c.isdigit())
        assert n == 1 and digits.startswith(kept) and [c for c in new if not c.isdigit()] == [c for c in text if not c.isdigit()]
        return digits[len(kept) :]

    for code, forms in {
        "49": ["+493015557713", "+49 301 555-7713", "+49 (301) 555-7713", "+49 30 15557713", "+49 30/155577-13"],
        "33": ["+33612345678", "+33 6 12 34 56 78", "+33 6.12.34.56.78"],
        "1": ["+10175557713", "+1 (017) 555-7713", "+1 017 5557713"],
        "351": ["+351912345678", "+351 912 345 678"],
    }.items():
        assert len({national(x, code) for x in forms}) == 1
    assert national("06 12 34 56 78", "", "0") == national("+33 (0)6 12 34 56 78", "33", "0") == national("+33 6 12 34 56 78", "33")
    assert national("(017) 555-7713", "") == national("+10175557713", "1")
    assert pii.replaced("+49 30 1234567", KEY)[1] == 1


@pytest.mark.parametrize("phone, other", [("+33 6 12 34 56 78", "12 rue"), ("+33 6 12 34 56 78", CARD), ("+49 30 1234567", "2020-02-03"), ("+49 30 1234567", "97.51.17.173"), ("+1 017 5557713", "4111 1111 1111 1111")])
def test_phones_next_to_others(phone, other):
    (a, n), (b, k) = pii.replaced(phone, KEY), pii.replaced(other, KEY)
    assert pii.replaced(f"{phone} {other}", KEY) == (f"{a} {b}", n + k)


def test_plus_signs_that_begin_no_phone():
    for text in ("+12.3456789", "+0.123456789", "+1234.56789"):
        assert pii.replaced(text, KEY) == (text, 0)
    assert pii.replaced("+1 4111 1111 1111 1111", KEY)[0] == "+1 " + pii.replaced("4111 1111 1111 1111", KEY)[0]


def test_every_neighbour_leaves_the_card():
    alone = pii.replaced(CARD, KEY)[0]
    for n in range(1000):
        for text in (f"{n} {{}}", f"{{}} {n}", f"{n}-{{}}", f"{n} {{}} {n}", f"{{}} {n}.51.17.999"):
            assert pii.replaced(text.format(CARD), KEY) == (text.format(alone), 1)


def test_lists_of_small_numbers_stay():
    changed = sum(pii.replaced(" ".join(str(n + i) for i in range(12)), KEY)[1] > 0 for n in range(100, 900))
    assert changed < 120  # one try in ten, as for any run of digits


def test_long_runs_are_linear():
    import time

    began = time.monotonic()
    for text in ("a" * 400_000, "1" * 400_000, "1 " * 200_000, "a." * 200_000 + "@", "@" * 200_000):
        pii.replaced(text, KEY)
    assert time.monotonic() - began < 20


def test_column(spark, docs_of, odd_texts):
    texts = dict(enumerate([*odd_texts, "x ana@b.com", "ana@b.com y"]))
    out = {r.doc_id: r for r in docs_of(spark, texts).select("doc_id", pii.pseudonymise("secret")("text").alias("p")).select("doc_id", "p.*").collect()}
    n = len(odd_texts)
    assert all(out[i].text == t and out[i].n_replaced == 0 for i, t in enumerate(odd_texts))
    assert out[n].text.split()[1] == out[n + 1].text.split()[0] != "ana@b.com"
    assert docs_of(spark, texts).limit(0).select(pii.pseudonymise("k")("text")).count() == 0


def test_digits_of_other_scripts_are_left_alone():
    date = "\u0662\u0660\u0662\u0660-\u0660\u0663-\u0662\u0665"
    for text in (date, f"{date} and 7", f"7 {date}"):
        assert pii.replaced(text, b"k") == (text, 0)


def test_one_pseudonym_for_spellings_of_a_number():
    """With and without grouping, for country codes of one to three digits."""
    for spellings in (("+442071234567", "+44 207 123 4567", "+44-20-7123-4567"), ("+12125550123", "+1 (212) 555-0123"), ("+351912345678", "+351 912 345 678")):
        new = {"".join(c for c in pii.replaced(f"call {x} now", b"k")[0] if c.isdigit()) for x in spellings}
        assert len(new) == 1
