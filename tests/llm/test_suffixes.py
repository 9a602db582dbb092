import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from boxloom.llm import suffixes


def brute(s):
    s = list(s)
    sa = sorted(range(len(s)), key=lambda i: s[i:])
    plcp = [0] * len(s)
    for a, b in zip(sa, sa[1:]):
        while b + plcp[b] < len(s) and a + plcp[b] < len(s) and s[a + plcp[b]] == s[b + plcp[b]]:
            plcp[b] += 1
    return sa, plcp


@settings(deadline=None, max_examples=300)
@given(st.one_of(st.binary(min_size=1, max_size=120), st.lists(st.integers(97, 99), min_size=1, max_size=200).map(bytes), st.tuples(st.binary(min_size=1, max_size=9), st.integers(1, 20)).map(lambda x: x[0] * x[1])))
def test_against_brute_force(data):
    s = np.frombuffer(data, np.uint8)
    sa, plcp = brute(data)
    got = suffixes.suffix_array(s, 256)
    assert got.tolist() == sa
    assert suffixes.doubled(s).tolist() == sa
    assert suffixes.permuted_common_prefixes(s, got).tolist() == plcp


def test_a_longer_text():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 102, int(rng.integers(1, 9))).astype(np.uint8)) for _ in range(50)]
    data = b" ".join(words[int(i)] for i in rng.integers(0, 50, 4000))
    data = data + data[1000:6000] + b"x" * 500
    s = np.frombuffer(data, np.uint8)
    got = suffixes.suffix_array(s, 256)
    assert got.tolist() == suffixes.doubled(s).tolist()
    a, b = got[:-1], got[1:]
    plcp = suffixes.permuted_common_prefixes(s, got)
    for i, j in zip(a[::50].tolist(), b[::50].tolist()):
        k = int(plcp[j])
        assert data[i : i + k] == data[j : j + k] and data[i + k : i + k + 1] != data[j + k : j + k + 1]


def test_long_runs_and_equal_long_substrings():
    parts = [b"a" * 3000 + b"b", b"a" * 3000 + b"b", b"ba" * 900, bytes(range(97, 123)) * 40, b"z" * 2000]
    s = np.frombuffer(b"".join(parts * 2), np.uint8)
    assert suffixes.suffix_array(s, 256).tolist() == suffixes.doubled(s).tolist()


def test_all_levels_are_induced(monkeypatch):
    """The recursion sorts names, not only bytes, whatever their number; both ways of induction agree."""
    seen = []
    real = suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda s, k: seen.append(k) or real(s, k))
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 110, int(rng.integers(2, 9))).astype(np.uint8)) for _ in range(3000)]
    data = np.frombuffer(b" ".join(words[int(i)] for i in np.minimum(rng.zipf(1.3, 80000) - 1, 2999)), np.uint8)
    got = suffixes.suffix_array(data, 256)
    assert len(seen) > 2 and max(seen) > 4096 and got.tolist() == suffixes.doubled(data).tolist()
    monkeypatch.setattr(suffixes, "WAVE", 1 << 40)
    assert suffixes.suffix_array(data, 256).tolist() == got.tolist()
