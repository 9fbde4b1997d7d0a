"""Fingerprints against a parse that goes symbol by symbol, in Python's whole numbers."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_text_operators import BASE, NEAR, frame

from tidemark.llm import lcp

ALL = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ALL
    return x ^ (x >> 31)


POWERS = [mix((k * ODD) & ALL) | 1 for k in range(1, 257)]


def toss(before, own, most=None):
    """Twice the lowest place in which two numbers differ, and the own bit there; ``most`` is a place that always counts."""
    differ = (before ^ own) | (1 << most if most else 0)
    low = (differ & -differ).bit_length() - 1 if differ else 0
    return 2 * low + (own >> low & 1)


def plain_level(names):
    runs = []
    for n in names:
        if runs and runs[-1][0] == n:
            runs[-1][1] += 1
        else:
            runs.append([n, 1])
    names = [n if k == 1 else mix((n + k * ODD) & ALL) for n, k in runs]
    first = [0] + [toss(a, b, 63) for a, b in zip(names, names[1:], strict=False)]
    second = [0] + [toss(a, b) for a, b in zip(first, first[1:], strict=False)]
    starts = [0] + [i for i in range(1, len(names) - 1) if second[i] > second[i - 1] and second[i] >= second[i + 1]]
    cut = []
    for a, b in zip(starts, [*starts[1:], len(names)], strict=True):
        cut += range(a, b, 200)
    return [mix((sum(names[i] * POWERS[i - a] for i in range(a, b)) + 1) & ALL) for a, b in zip(cut, [*cut[1:], len(names)], strict=True)]


def plain(text):
    names, sets, level = [mix(ord(c) + 1) for c in text], [], 0
    while names and (level < 3 or len(names) > 1):
        names, level = plain_level(names), level + 1
        if level in (2, 3):
            sets.append(sorted(set(names))[:32])
    root = names[0] if names else 0
    return ".".join([f"{root:016x}", *("".join(f"{n:016x}" for n in s) for s in (sets or [[], []]))])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc \né日", max_size=120), min_size=1, max_size=4))
def test_parse_like_the_plain_one(texts):
    assert lcp.fingerprints(texts) == [plain(t) for t in texts]


def test_long_texts_and_neighbours_in_a_batch():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(5000)), "", "a" * 3000, "ab" * 700, BASE, "b", "b"]
    assert lcp.fingerprints(texts) == [plain(t) for t in texts] == [f for t in texts for f in lcp.fingerprints([t])]


def jaccard(a, b):
    sets = [[set(x[i : i + 16] for i in range(0, len(x), 16)) for x in f.split(".")[1:]] for f in (a, b)]
    return [len(x & y) / len(x | y) if x | y else 0.0 for x, y in zip(*sets, strict=True)]


@settings(max_examples=100, deadline=None)
@given(st.text("abcd ", max_size=60), st.text("abcd ", max_size=60))
def test_likeness_of_small_sets_is_exact(a, b):
    x, y = lcp.fingerprints([a, b])
    if all(len(s) < 16 * 32 for f in (x, y) for s in f.split(".")[1:]):
        assert lcp.likeness(x, y) == pytest.approx(1.0 if x.split(".")[0] == y.split(".")[0] else sum(jaccard(x, y)) / 2)


def test_likeness_is_near_the_share_of_common_phrases():
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(3000)]
    for share in (0.1, 0.5, 0.9):
        other = words[: int(share * 3000)] + [f"v{rng.randint(0, 5000)}" for _ in range(int((1 - share) * 3000))]
        a, b = " ".join(words), " ".join(other)
        sets = []
        for t in (a, b):
            names = [mix(ord(c) + 1) for c in t]
            for _ in range(2):
                names = plain_level(names)
            sets.append(set(names))
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert abs(lcp.likeness(*lcp.fingerprints([a, b])) - true) < 0.3


def test_query_rows_like_the_plain_ones(spark):
    rows = [(3, BASE), (1, " ".join(NEAR)), (2, None), (9, "x"), (5, BASE), (4, "日本" * 50)]
    got = {r["doc_id"]: r for r in lcp.fingerprint(frame(spark, rows)).collect()}
    order = sorted(rows)
    for (i, text), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        changed = lcp.edited(text or "", following or "")
        assert got[i]["fingerprint"] == plain(text or "") and got[i]["edited_fingerprint"] == plain(changed)
        assert got[i]["near_next"] == lcp.likeness(plain(text or ""), plain(following or "")) and got[i]["n_chars"] == len(text or "")
    assert got[3]["fingerprint"] == got[5]["fingerprint"] and np.isfinite([r["near_edited"] for r in got.values()]).all()
