"""Quotations of many sentences, closed and cut off."""

import pytest

from pairloom.llm.sentences import units


def cut(text):
    return [text[a:b] for a, b in units(text)]


@pytest.mark.parametrize("n", [3, 63, 65, 320])
@pytest.mark.parametrize(("left", "right"), ['""', "“”", "«»"])
def test_a_long_quotation_stays_whole(n, left, right):
    said = "The log reads: " + left + " ".join(f"Chain {k} was rebuilt." for k in range(n)) + right
    assert cut(f"It is so. {said} Next it closed. Then it opened.") == ["It is so.", said, "Next it closed.", "Then it opened."]


def test_a_long_quotation_that_is_cut_off():
    said = "The log reads: “" + " ".join(f"Chain {k} was rebuilt." for k in range(320)) + " Noth"
    assert cut(f"First. {said}") == ["First.", said]
    assert len(cut(f"{said}ing else.\n\nIt is so. And so")) > 320  # not the last block: a quotation nothing closes over so many sentences is a stray mark


def test_a_short_quotation_that_nothing_closes():
    assert cut("First. The log reads: “It is so. Nothing else.") == ["First.", "The log reads: “It is so. Nothing else."]


def test_many_places_in_and_out_of_quotations():
    text = "It is so. " * 3000 + "“" + "It is so. " * 3000 + "It” is. " + "It is so. " * 3000 + "So"
    assert len(cut(text)) == 6002
