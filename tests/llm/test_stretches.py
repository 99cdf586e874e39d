"""Random secrets of any length, without digits, and in paths."""

import random
import string

import pytest

from marlstone.llm import secrets

WORDS = "house water tree people window handler table market letter number garden winter summer example clown straße garçon country morning evening paper picture".split()
LETTERS = string.ascii_letters


@pytest.fixture(scope="module")
def model():
    known = secrets.identifiers(WORDS, 6000)
    return secrets.Markov(secrets.random_strings(6000), known + [s.upper() for s in known[::2]])


@pytest.mark.parametrize(
    ("before", "signs", "n"),
    [("", LETTERS + string.digits, 12), ("", LETTERS + string.digits, 16), ("", string.ascii_lowercase, 16), ("", string.ascii_uppercase, 16), ("", string.digits + string.ascii_lowercase, 12), ("", string.digits + "ABCDEF", 32), ("", string.ascii_lowercase, 32), ("src/house/water/tree/", LETTERS + string.digits, 24), ("house/water/tree/table=", LETTERS + string.digits, 32)],
)
def test_found_in_its_setting(model, before, signs, n):
    draw = random.Random(n)
    found = 0
    for _ in range(200):
        secret = "".join(draw.choices(signs, k=n))
        text = f"é see {before}{secret} there"
        at = 6 + len(before)
        spans = secrets.all_spans(text, model, 0.5)[1]
        found += any(s <= at and e >= at + n for s, e, _ in spans)
        if before and spans:
            assert all(s >= 6 for s, _, _ in spans)
    assert found >= 180


def test_ordinary_text_is_left_alone(model):
    draw = random.Random(1)
    for x in secrets.identifiers(WORDS, 400, 98):
        assert not secrets.stretches(x, model, 0.5)
    assert not secrets.stretches(" ".join(draw.choices([w for w in WORDS if w.isascii()], k=400)), model, 0.5)
    assert not secrets.stretches("", model, 0.5) and not secrets.stretches("a", model, 0.5)


def test_spans_against_every_pair(model):
    draw = random.Random(7)
    text = " ".join(draw.choice((draw.choice(WORDS), "".join(draw.choices(LETTERS + string.digits, k=24)), "token=" + "".join(draw.choices(LETTERS, k=20)), "".join(draw.choices("0123456789abcdef", k=40)))) for _ in range(400))
    base, spans = secrets.all_spans(text, model, 0.5)
    found = secrets.stretches(text, model, 0.5)
    taken = {i for s, e, _ in base for i in range(s, e)}
    left = [i for a, b in found for i in range(a, b) if i not in taken]
    firsts = {a for a, _ in found}
    cuts = [i for i, x in enumerate(left) if i == 0 or x != left[i - 1] + 1 or x in firsts] + [len(left)]
    want = [(left[i], left[j - 1] + 1, "random") for i, j in zip(cuts, cuts[1:], strict=False)]
    assert sorted(spans) == sorted(base + want) and len(base) > 150 and len(want) > 50
    assert [s for s, _, _ in spans] == sorted(s for s, _, _ in spans)


def test_a_stretch_keeps_what_lies_outside_base_spans(spark, model):
    text = "key 0123456789abcdefZK9QxV2mN7pL4rT8wY1bC6dF3 end"
    assert secrets.base_spans(text) == [(4, 20, "hex")]
    assert secrets.all_spans(text, model, 0.5)[1] == [(4, 20, "hex"), (20, 45, "random")]
    rows = spark.createDataFrame([(1, text, len(text))], "doc_id int, text string, n_chars int")
    assert [tuple(r) for r in secrets.redact(rows, model).collect()] == [(1, "key [secret] end", 16)]
    assert secrets.outside([(0, 10), (12, 20)], [(2, 4, "a"), (3, 5, "b"), (8, 14, "c"), (18, 30, "d")]) == [(0, 2), (5, 8), (14, 18)]


def test_long_text_is_linear(model):
    one = "see 0123456789abcdef0123 and house/water/kJ8sLq2ZpXv91TgHwRbN here "
    base, spans = secrets.all_spans(one * 20_000, model, 0.5)
    assert len(base) == 20_000 and len(spans) == 40_000
