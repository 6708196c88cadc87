"""Cards and IBANs with further digits or capitals behind them."""

import pytest

from sedgewren.llm import pii

CARDS = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "5500 0055 5555 5559", "3782 822463 10005"]


@pytest.mark.parametrize("card", CARDS)
@pytest.mark.parametrize("after", [" 123", " 12/27", " 2027", " 1234", "-123", " 12 27 123"])
def test_card_and_what_follows(card, after):
    text, spans = pii.pseudonymise(f"pay {card}{after} now", b"k")
    kind, start, end, new = spans[0]
    assert (kind, start) == ("card", 4) and end >= 4 + len(card) and card not in text
    whole = "".join(c for c in card + after.split("/")[0] if c.isdigit())
    if len(whole) > 19 or pii.luhn_digit(whole[:-1]) != whole[-1]:  # else the longest is a valid number too
        assert end == 4 + len(card) or pii.card(pii.re.match(".*", f"{card}{after}"[: end - 4]), b"k", False)
    assert text == f"pay {new}{(card + after)[end - 4:]} now"


def test_iban_and_what_follows():
    iban = "ES91 2100 0418 4502 0005 1332"
    for after in (" 2024", " EUR", " 12"):
        text, spans = pii.pseudonymise(f"to {iban}{after}.", b"k")
        assert [s[:3] for s in spans] == [("iban", 3, 3 + len(iban))] and iban not in text and text.endswith(f"{after}.")
