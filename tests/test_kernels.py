"""Kernels: golden vectors, round trips over arbitrary bytes, and errors on damaged input."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlog.functions import bits, codecs, deltas
from strandlog.functions.distances import Measure, cosine, grams, minhash, minhash_params, mt19937_64
from strandlog.operators import blocks

text = st.text(alphabet=st.sampled_from(list("ab$#\r\x00é ,")), max_size=30).map(str.encode) | st.binary(max_size=30)


def test_rle_golden():
    assert bits.rle_encode([0, 1] * 4) == (bytes.fromhex("12492480"), 8)
    assert bits.rle_encode([0] * 5 + [1] * 5 + [0] * 5) == (bytes.fromhex("56B5"), 3)
    assert bits.rle_encode([0] * 10) == (b"\x6a", 1) and bits.rle_encode([1] * 10) == (b"\xea", 1) and bits.rle_encode([]) == (b"", 0)


@pytest.mark.parametrize("v", [[0], [1], [0, 1, 1, 1, 1], [0, 1] * 25_000, [0] * 200_000, [0, 0, 1, 1, 1, 0, 1, 0, 0, 0, 1, 1, 0]])
def test_rle_round_trip(v):
    assert bits.rle_decode(*bits.rle_encode(v)) == v


def test_bitpack():
    v = [5, 7, 3, 3, 4, 2, 4, 2, 5, 12, 23]
    assert bits.bitpack_encode(v) == bytes.fromhex("0529C63208822B2E") and bits.bitpack_decode(bits.bitpack_encode(v), 11) == v
    assert bits.bitpack_decode(bits.bitpack_encode([0] * 9), 9) == [0] * 9 and bits.bitpack_encode([]) == b""
    with pytest.raises(ValueError):
        bits.bitpack_encode([-1])
    with pytest.raises(ValueError):
        bits.bitpack_decode(bits.bitpack_encode(v)[:-2], 11)


def test_ts2diff_golden():
    assert bits.ts2diff_encode(list(range(1, 11))) == bytes.fromhex("00000001000000010000000100901000")


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 128, 129, 1000])
def test_ts2diff_sizes(n):
    for v in ([i % 100 for i in range(n)], [-100 if i % 2 else 100 for i in range(n)], [2 * i for i in range(n)], [(i * 7919) % 1000 - 500 for i in range(n)]):
        assert bits.ts2diff_decode(bits.ts2diff_encode(v)) == v
    with pytest.raises(ValueError):
        bits.ts2diff_encode([2**63])


@given(st.lists(st.integers(-(2**30), 2**30), max_size=200))
def test_ts2diff_any(v):
    data = bits.ts2diff_encode(v)
    assert bits.ts2diff_decode(data) == v
    if v:
        with pytest.raises(ValueError):
            bits.ts2diff_decode(data[:-1])


@given(st.lists(st.integers(0, 2**40), max_size=100))
def test_bitpack_any(v):
    assert bits.bitpack_decode(bits.bitpack_encode(v), len(v)) == v


@given(text, text, st.integers(1, 5))
@settings(max_examples=400)
def test_scripts_apply(old, new, q):
    ops, cost = deltas.approximate(old, new, q)
    assert deltas.apply(ops, old) == new and cost == deltas.script_cost(ops)
    ops, cost = deltas.exact(old, new)
    assert deltas.apply(ops, old) == new and cost >= 0


def test_script_cases():
    assert deltas.approximate(b"abcdefgh", b"abcdefgh") == ([], 5.0) and deltas.exact(b"x", b"x") == ([], 0.0)
    assert deltas.exact(b"", b"abc") == ([(0, 0, b"abc")], 8.0) and deltas.exact(b"abc", b"") == ([(0, 3, b"")], 5.0)
    for new in (b"$$abcdefgh", b"abcdefgh##", b""):
        assert deltas.apply(deltas.approximate(b"abcdefgh", new)[0], b"abcdefgh") == new
    ops, cost = deltas.approximate(b"2024 error 17 x", b"2024 error 99 x")
    assert ops == [(11, 2, b"99")] and cost == 10.0
    assert deltas.exact(b"2024 error 17 x", b"2024 error 99 x") == ([(11, 2, b"99")], 5.0)


def test_distances():
    a = b"Jun  9 06:06:51 combo anacron: anacron startup succeeded"
    b = b"Jun  9 06:06:51 combo atd: atd startup succeeded"
    ga, gb = grams(a, 3), grams(b, 3)
    assert cosine(ga, 68, gb, 52) == pytest.approx(0.3273272060036875, abs=1e-15)
    assert mt19937_64(5489, 10000)[-1] == 9981545732273789042
    assert minhash_params()[0][:2] == [6597103971274460346, 12716877617435052285] and minhash_params()[1][0] == 7386862472818278521
    assert minhash(b'2024-01-01 00:09:58 13 error 185.22 {"k": 87}')[:3].tolist() == [12317520698, 14258831067, 176703565752]
    m = Measure("minhash", 2)
    assert m.between(b"ab", m.prepare(b"ab"), b"cd", m.prepare(b"cd")) == 0.0  # both without 3-grams
    m = Measure("minhash", 3)
    assert m.between(b"ab", m.prepare(b"ab"), b"cd", m.prepare(b"cd")) == 1.0 and m.between(b"", m.prepare(b""), b"", m.prepare(b"")) == 0.0
    with pytest.raises(ValueError):
        Measure("euclid")
    with pytest.raises(ValueError):
        Measure("cosine", 0)


@pytest.mark.parametrize("name", codecs.NAMES)
def test_codecs(name):
    for data in (b"", b"x", bytes(range(256)) * 10, b"a" * 1_000_000):
        assert codecs.decompress(codecs.compress(data, name), name) == data
    with pytest.raises(ValueError):
        codecs.compress(b"", "lz77")


def test_damaged_block():
    rows = [{"method": 1, "ops": None, "begin": -1}, {"method": 0, "ops": [(0, 1, b"xy"), (3, 0, b"z")], "begin": 0}, {"method": 0, "ops": [], "begin": 1}]
    data = blocks.encode(rows, [b"abc\n", b"?", b"?"])
    assert blocks.decode(data) == [(0, None, b"abc\n"), (0, [(0, 1, b"xy"), (3, 0, b"z")], None), (1, [], None)]
    for bad in (data[:-1], data[:-5] + bytes([data[-5] ^ 1]) + data[-4:], b""):
        with pytest.raises(ValueError):
            blocks.decode(bad)


def test_wide_deltas():
    from strandlog.functions.bits import ts2diff_decode, ts2diff_encode

    for v in ([2**31], [0, 2**31 - 1, -(2**31)], [2**62, 0, 5], list(range(2**31 - 40, 2**31 + 90)), [-(2**63) + 1, -1]):
        assert ts2diff_decode(ts2diff_encode(v)) == v
    assert ts2diff_encode([1, 2, 3])[:4] == b"\0\0\0\1"
    with pytest.raises(ValueError):
        ts2diff_encode([2**63])
    with pytest.raises(ValueError):
        ts2diff_decode(ts2diff_encode([2**40, 1, 2])[:-1])


def test_exact_scripts_refuse_long_strings():
    from strandlog.functions.deltas import exact

    with pytest.raises(ValueError, match="too long"):
        exact(b"a" * 1000, b"b" * 1000)


def test_many_signatures_equal_one_by_one():
    import numpy as np

    from strandlog.functions.distances import gram_matrix, grams, minhash, minhash_many

    r = np.random.default_rng(3)
    lines = [bytes(r.integers(97, 101, int(n)).tolist()) for n in r.integers(0, 60, 300)] + [b"", b"ab", b"abc", b"x" * 500, b"\xff\x00\xfe" * 9]
    for most in (1 << 16, 100, 1):
        assert (minhash_many(lines, most) == np.array([minhash(x) for x in lines])).all()
    for q in (1, 3, 8):
        m = gram_matrix(lines, q)
        assert m.sum() == sum(max(0, len(x) - q + 1) for x in lines) and (m @ m.T)[3, 7] == sum(n * grams(lines[7], q)[g] for g, n in grams(lines[3], q).items())
    assert gram_matrix(lines, 3, 10) is None


def _plain_exact(old, new, most):
    """The recurrence cell by cell, with all earlier cells looked at one by one."""
    m, n = len(old), len(new)
    cost, came = {(0, j): 3.0 * (j > 0) + j for j in range(n + 1)}, {(0, j): (0, j - 1) for j in range(1, n + 1)}
    for i in range(1, m + 1):
        cost[i, 0], came[i, 0] = 3.0, (i - 1, 0)
        for j in range(1, n + 1):
            if old[i - 1] == new[j - 1]:
                cost[i, j] = cost[i - 1, j - 1]
                continue
            common, reach = {}, []
            for p, r in ((p, r) for p in range(i - 1, -1, -1) for r in range(j - 1, -1, -1)):
                at = lambda x, y: common.get((x, y), 0)  # noqa: E731, B023
                common[p, r] = at(p + 1, r + 1) + 1 if old[p] == new[r] else max(at(p + 1, r), at(p, r + 1))
                if common[p, r] >= most:
                    break
                reach.append((p, r))
            cost[i, j], _, came[i, j] = min((cost[c] + 3.0 * (c not in came) + j - c[1], k, c) for k, c in enumerate(reach))
    ops, (i, j) = [], (m, n)
    while i or j:
        if (i, j) not in came:
            i, j = i - 1, j - 1
            continue
        p, r = came[i, j]
        if ops and ops[-1][0] == i:
            _, deleted, inserted = ops.pop()
            ops.append((p, i - p + deleted, new[r:j] + inserted))
        else:
            ops.append((p, i - p, new[r:j]))
        i, j = p, r
    return ops[::-1], cost[m, n]


def test_many_exact_scripts_equal_the_recurrence():
    import random

    draw = random.Random(4)
    pairs = []
    for _ in range(250):
        letters = draw.choice([b"ab", b"abc", b"abcdefgh"])
        old = bytes(draw.choices(letters, k=draw.randint(1, 14)))
        new = bytes(draw.choices(letters, k=draw.randint(1, 14))) if draw.random() < 0.5 else bytes(c if draw.random() < 0.8 else draw.choice(letters) for c in old) + b"z" * draw.randint(0, 2)
        pairs.append((old, new))
    pairs = [p for p in pairs if p[0] != p[1]]
    for most in (1, 2, 3, 5):
        assert deltas.exact_many(pairs, most) == [_plain_exact(*p, most) for p in pairs]
    odd = [(b"", b"ab"), (b"x", b"x"), (b"\xff\x00", b"\x00"), (b"ab", b""), (b"", b"")]
    assert deltas.exact_many(odd) == [deltas.exact(*p) for p in odd] and deltas.exact_many([]) == []


def test_exact_scripts_take_time_by_the_product_of_lengths():
    import time

    began = time.process_time()
    assert deltas.exact(b"a" * 500, b"b" * 500) == ([(0, 500, b"b" * 500)], 503.0)
    assert len(deltas.exact_many([(b"a" * 120, b"b" * 119 + bytes([i])) for i in range(100)])) == 100
    assert time.process_time() - began < 10
