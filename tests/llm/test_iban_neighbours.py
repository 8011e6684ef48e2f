"""IBANs with capital words, numbers or other IBANs behind them."""

import pytest

from strandweave.llm import pii

CODES = ["AT61 1904 3002 3457 3201", "ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "BE68 5390 0754 7034", "GB82WEST12345698765432"]


def found(text):
    return [text[a:b] for k, a, b in pii.spans_of(text) if k == "iban"]


@pytest.mark.parametrize("code", CODES)
@pytest.mark.parametrize("behind", ["", " BIC", " EUR", " BANK BIC", " 2024", " COBADEFF", " COBA DE FF", ", BIC"])
def test_neighbours_do_not_hide_an_iban(code, behind):
    assert found(f"IBAN {code}{behind} end") == [code]
    assert found(f"IBAN {code}{behind}") == [code]


def test_ibans_in_a_row():
    assert found(" ".join(CODES)) == CODES
    assert found("AB12 CDEF GHIJ AT61 1904 3002 3457 3201 BIC") == ["AT61 1904 3002 3457 3201"]


def test_wrong_digits_stay_unconfirmed():
    assert found("IBAN AT61 1904 3002 3457 3202 BIC, ES9121000418450200051333 EUR") == []


def test_masking_reaches_them():
    text = "IBAN AT61 1904 3002 3457 3201 BIC RZBAATWW"
    assert pii.masked(text, pii.scored(text, pii.spans_of(text))) == "IBAN <IBAN> BIC RZBAATWW"
