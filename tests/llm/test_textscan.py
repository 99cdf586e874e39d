import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import textscan as T

TEXT = st.text(alphabet=st.sampled_from("ab \t\n\x0b\x0c\ré\x1c\xa0漢#1"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_and_hashes(rows):
    t = T.texts(pa.array(rows, pa.string()))
    w = T.words(t)
    want = [re.findall(r"[^\x20\x09-\x0D]+", r or "") for r in rows]
    got = [[t.data[s:e].tobytes().decode() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == want
    h = T.hash_words(t.data, w)
    flat = [x for r in want for x in r]
    assert len(set(flat)) == len(set(h.tolist())) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))
    for n in (2, 3, 5):
        g, ok = T.gram_hash(h, n), T.whole(w, n)
        keys = [tuple(flat[i : i + n]) for i in range(len(g))]
        assert len(set(keys)) == len(set(g.tolist())) and len(ok) == len(g)


def test_long_words_and_slices():
    long = "x" * (T.LONG_WORD + 5)
    a = pa.array(["skip", f"a {long} b", f"{long}", "y" * (T.BLOCK * 2) + " a"]).slice(1)
    t = T.texts(a)
    w = T.words(t)
    h = T.hash_words(t.data, w)
    assert len(h) == 6 and h[1] == h[3] and h[0] == h[5] and len(set(h.tolist())) == 4
    parts = [(p[0], p[1]) for p in T.pieces(t, 10)]
    assert parts == [(0, 1), (1, 2), (2, 3)]


def test_pieces_agree_with_whole():
    rows = ["a b c d e f g"] * 5 + ["", None, "h i"]
    t = T.texts(pa.array(rows))
    whole = T.hash_words(t.data, T.words(t))
    split = np.concatenate([T.hash_words(p.data, T.words(p)) for _, _, p in T.pieces(t, 20)])
    assert (whole == split).all()


def thue_morse(k: int) -> tuple[str, str]:
    """Two words of 2**k letters that every polynomial hash modulo 2**64 confuses from k = 10 or 11 on."""
    bits = [bin(i).count("1") & 1 for i in range(1 << k)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_do_not_confuse_thue_morse_words():
    pair = thue_morse(12)
    t = T.texts(pa.array([" ".join(pair)]))
    for family in (0, 1):
        a, b = T.hash_words(t.data, T.words(t), family)
        assert a != b
    assert T.hash_words(t.data, T.words(t), 0)[0] != T.hash_words(t.data, T.words(t), 1)[0]
