"""Exact integer linear algebra for symmetric positive semidefinite matrices: characteristic polynomial, roots, components.

The polynomial is found modulo primes (Hessenberg form, then its recurrence, many primes at once in numpy) and put together
by Chinese remainders. All its roots are real, so by Descartes' rule the number of roots above a point is exactly the number
of sign changes of the polynomial shifted there; bisection in integers isolates and narrows every root as far as wanted, and
tells equal roots from close ones. Components come from inverse iteration with a fixed-point LU of hundreds of bits.
"""

from __future__ import annotations

import math

import numpy as np

RESOLUTION = 256  # bits to which a root is narrowed, relative to the trace
POINT = 640  # bits after the point in solving


def primes_below(top: int, bits: int) -> list[int]:
    """The largest odd primes below top, as many as their product needs to pass 2^bits."""
    small = [2, 3, 5, 7]  # Miller-Rabin with these bases is exact below 3,215,031,751

    def prime(n: int) -> bool:
        d, s = n - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        for a in small:
            x = pow(a, d, n)
            if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
                return False
        return True
    found, product, n = [], 1, top - 1 - top % 2
    while product.bit_length() <= bits:
        if prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def residues(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients (constant term first, leading 1 last) of det(x - matrix) modulo each prime below 2^31."""
    d = len(matrix)
    p = np.array(primes, np.int64)
    a = np.array([[[v % q for v in row] for row in matrix] for q in primes], np.int64)
    each, q2, q3 = np.arange(len(primes)), p[:, None], p[:, None, None]
    for k in range(1, d - 1):
        below = a[:, k:, k - 1]
        pick = k + np.argmax(below != 0, axis=1)  # a column of zeros picks row k: nothing to clear
        rows = a[each, pick].copy()
        a[each, pick], a[:, k] = a[:, k].copy(), rows
        columns = a[each, :, pick].copy()
        a[each, :, pick], a[:, :, k] = a[:, :, k].copy(), columns
        inverse = np.array([pow(int(v), -1, q) if v else 0 for v, q in zip(a[:, k, k - 1], primes)], np.int64)
        factor = a[:, k + 1:, k - 1] * inverse[:, None] % q2
        a[:, k + 1:] = (a[:, k + 1:] - factor[:, :, None] * a[:, k][:, None, :] % q3) % q3
        a[:, :, k] = (a[:, :, k] + (a[:, :, k + 1:] * factor[:, None, :] % q3).sum(axis=2)) % q2
    poly = np.zeros((len(primes), d + 1, d + 1), np.int64)  # polynomial of each leading block
    poly[:, 0, 0] = 1
    for k in range(1, d + 1):
        weight, chain = np.zeros((len(primes), k), np.int64), np.ones(len(primes), np.int64)
        for i in range(k - 1, -1, -1):
            weight[:, i] = a[:, i, k - 1] * chain % p
            chain = chain * (a[:, i, i - 1] if i else 0) % p
        part = (weight[:, :, None] * poly[:, :k] % q3).sum(axis=1) % q2
        poly[:, k, 1:] = poly[:, k - 1, :-1]
        poly[:, k] = (poly[:, k] - part) % q2
    return poly[:, d]


def coefficient_bits(trace: int, d: int) -> int:
    """Bits of the largest coefficient: with roots of sum t, the k-th symmetric sum is at most C(d, k) (t / d)^k."""
    return max((math.comb(d, k) * trace ** k // d ** k + 1).bit_length() for k in range(d + 1)) + 1


def combine(found: np.ndarray, primes: list[int]) -> list[int]:
    """Integer coefficients of a polynomial without negative roots from its residues: signs alternate."""
    product = math.prod(primes)
    parts = [product // q * pow(product // q % q, -1, q) for q in primes]
    d = found.shape[1] - 1
    out = []
    for k in range(d + 1):
        sign = -1 if (d - k) % 2 else 1
        out.append(sign * (sum(int(r) * sign % q * x for r, q, x in zip(found[:, k], primes, parts)) % product))
    return out


def above(poly: list[int], point: int) -> int:
    """How many roots (equal ones counted each) lie above an integer point, for a polynomial with real roots only."""
    c = list(reversed(poly))
    for end in range(len(c), 1, -1):
        for i in range(1, end):
            c[i] += c[i - 1] * point
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value(poly: list[int], point: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * point + c
    return out


def largest_roots(poly: list[int], trace: int, wanted: int, bits: int = RESOLUTION) -> tuple[list[tuple[int, int]], int]:
    """The largest positive roots, falling, as (root, multiplicity), roots in units of 2^-scale, and that scale.

    Multiplicities add up to `wanted` at least, or to all positive roots. Roots that a cell of trace * 2^-bits does not
    part count as equal.
    """
    scale = max(0, bits - trace.bit_length() + 1)
    d = len(poly) - 1
    fine = [c << scale * (d - k) for k, c in enumerate(poly)]  # roots times 2^scale
    counts = {0: above(fine, 0), trace << scale: 0}
    width = max(1, (trace << scale) >> bits)
    out: list[tuple[int, int]] = []
    got = 0
    while got < min(wanted, counts[0]):
        low = max(x for x, n in counts.items() if n > got)
        high = min(x for x, n in counts.items() if n <= got)
        while high - low > width:
            middle = (low + high) // 2
            if counts[low] - counts[high] == 1:  # one simple root in (low, high]: its sign change is enough
                here = value(fine, middle)
                side = (here > 0) == (counts[high] % 2 == 0) and here != 0
                counts[middle] = counts[high] if side or here == 0 else counts[low]
            else:
                counts[middle] = above(fine, middle)
            if counts[middle] > got:
                low = middle
            else:
                high = middle
        out.append((high, counts[low] - counts[high]))
        got = counts[low]
    return out, scale


def _shifted(matrix: list[list[int]], root: int, scale: int) -> np.ndarray:
    """matrix - root in fixed point, divided by a power of two above the trace."""
    size = sum(matrix[i][i] for i in range(len(matrix))).bit_length()
    a = np.array([[(v << POINT) >> size for v in row] for row in matrix], object)
    for i in range(len(matrix)):
        a[i, i] -= (root << POINT) >> (size + scale)
    return a


def null_space(matrix: list[list[int]], root: int, scale: int, wanted: int, rounds: int = 4) -> np.ndarray:
    """`wanted` orthonormal vectors of the root's eigenspace by inverse iteration, as doubles."""
    a, d = _shifted(matrix, root, scale), len(matrix)
    order = list(range(d))
    for k in range(d):
        pick = max(range(k, d), key=lambda i: abs(a[i, k]))
        if pick != k:
            a[[k, pick]] = a[[pick, k]]
            order[k], order[pick] = order[pick], order[k]
        if a[k, k] == 0:
            a[k, k] = 1
        for i in range(k + 1, d):
            if a[i, k]:
                factor = (a[i, k] << POINT) // a[k, k]
                a[i, k + 1:] -= (a[k, k + 1:] * factor) >> POINT
                a[i, k] = factor
    draw = np.random.default_rng(1)
    vectors = [np.array([int(x) << POINT for x in draw.integers(-1000, 1000, d)], object) for _ in range(wanted)]
    for _ in range(rounds):
        for n, v in enumerate(vectors):
            b = v[order].copy()
            for k in range(d):
                b[k + 1:] -= (a[k + 1:, k] * b[k]) >> POINT
            for k in range(d - 1, -1, -1):
                b[k] = (b[k] << POINT) // a[k, k]
                b[:k] -= (a[:k, k] * b[k]) >> POINT
            vectors[n] = _unit(b)
            for _ in range(2):
                for m in range(n):
                    share = int((vectors[m] * vectors[n]).sum()) >> POINT
                    vectors[n] = vectors[n] - ((vectors[m] * share) >> POINT)
                vectors[n] = _unit(vectors[n])
    return np.array([[x / (1 << POINT) for x in v] for v in vectors], float)


def _unit(v: np.ndarray) -> np.ndarray:
    """v at length one, its largest entry positive."""
    length = math.isqrt(int((v * v).sum())) or 1
    top = max(range(len(v)), key=lambda i: abs(v[i]))
    sign = -1 if v[top] < 0 else 1
    return np.array([sign * (int(x) << POINT) // length for x in v], object)
