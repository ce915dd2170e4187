"""Planted names, addresses and numbers: none is left, and who is the same stays the same."""

import random
import re

import pytest

from clauselake.llm import pii

GIVEN = ["Jean-Pierre", "Anna", "Ludwig", "José", "Marie-Claire", "Zoë", "Иван", "D.", "J. R.", ""]
FAMILY = ["Dupont", "O'Hara", "D’Angelo", "Smith-Jones", "Müller", "van der Berg", "van Beethoven", "de la Cruz", "von Trapp", "Петров", "Nuñez"]
TITLES = ["Mr", "Mr.", "Mrs", "Herr", "Frau", "Madame", "Dr.", "Prof."]
BETWEEN = ["called", "said that the house is near", "met", "und", "was at the river when", "wrote to"]


def parts(name):
    """Words of a name that tell who it is, by a plain loop."""
    return [w for w in re.split(r"[-'’ .]", name) if len(w) > 1 and w[0].isupper()]


def test_no_planted_name_is_left():
    rng = random.Random(4)
    for _ in range(300):
        people = [(rng.choice(TITLES), rng.choice(GIVEN), rng.choice(FAMILY)) for _ in range(3)]
        said = [f"{t} {g} {f}".replace("  ", " ") for t, g, f in people]
        text = f"{said[0]} {rng.choice(BETWEEN)} {said[1]}, then {said[2]} left. {' '.join(parts(people[0][2]))}'s book; {parts(people[1][2])[-1]} left."
        new, n = pii.replaced(text, b"key", {})
        words = set(re.findall(r"[^\W\d_]+", new))
        for _, given, family in people:
            assert not words & {*parts(given), *parts(family)}, (text, new)
        assert n >= 5 and re.sub(r"\w+", "w", new) == re.sub(r"\w+", "w", text)


@pytest.mark.parametrize(
    "text,forms",
    [
        ("Mr Jean-Pierre Dupont called. Dupont left.", ["given:m jean", "given:m pierre", "family:n dupont", "family:n dupont"]),
        ("Mrs O'Hara came", ["family:n hara"]),
        ("Mr van der Berg came", ["family:n berg"]),
        ("Mr D. Trump came", ["given:m d", "family:n trump"]),
        ("Herr Ludwig van Beethoven spielt", ["given:m ludwig", "family:n beethoven"]),
        ("Mr Smith's dog", ["family:n smith"]),
        ("Mr Smith met Mrs Smith", ["family:n smith", "family:n smith"]),
        ("Mr a man", []),
        ("Mr D. was here", []),
        ("Dr", []),
    ],
)
def test_names(text, forms):
    assert [f"{kind} {form}" for _, _, kind, form in pii.find(text)] == forms


def test_one_number_has_one_surrogate():
    same = ["+33 6 12 34 56 78", "0033 6 12 34 56 78", "+33 (0)6 12 34 56 78", "+33612345678"]
    made = set()
    for number in same:
        new, n = pii.replaced(f"call {number}.", b"k", {})
        shown = new[5:-1]
        assert n == 1 and re.sub(r"\d", "0", shown) == re.sub(r"\d", "0", number)
        assert "(0)" not in number or "(0)" in shown
        made.add(re.sub(r"\D", "", shown.replace("(0)", "")).removeprefix("00"))
    assert len(made) == 1 and not made & {"33612345678"}


def test_addresses_keep_their_case():
    new, _ = pii.replaced("to Anna.B@Example.com or anna.b@example.com", b"k", {})
    first, second = re.findall(r"\S+@\S+", new)
    assert first != second and first.lower() == second and [c.isupper() for c in first] == [c.isupper() for c in "Anna.B@Example.com"]


def test_many_names_take_time_in_proportion():
    import time

    def took(n):
        letters = "abcdefghijklmnopqrstuvwxyz"
        names = ["B" + letters[i // 676 % 26] + letters[i // 26 % 26] + letters[i % 26] + "mer" for i in range(n)]
        text = "; ".join(f"Mr {x}" for x in names) + ". " + " ".join(names)
        began = time.process_time()
        assert len(pii.find(text)) == 2 * n
        return time.process_time() - began

    took(200)
    assert took(4000) < 12 * took(1000) + 0.2
