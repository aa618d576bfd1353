"""Distances of many pairs at once, in blocks of numpy: the numbers of ``functions.vectors``, as sums fold in the same order.

Vectors are matrices of doubles, a row each. ``METHODS`` has a method for each metric whose pairs are scored so; a metric
without one is an expression, pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

#: Queries and rows of a block: its numbers stay in a core's cache while all components pass.
BLOCK = 64, 512

#: Components, of rows and of queries, whose shapes broadcast.
Components = Iterator[tuple[np.ndarray, np.ndarray]]


def fold(parts: Components, term: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(shape)
    for x, y in parts:
        out += term(x, y)
    return out


def square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    step = x - y
    return np.multiply(step, step, out=step)


@dataclass(frozen=True)
class Method:
    """A distance: ``exact`` by components, and ``near``, a cheap one by matrix products.

    near(q, v) gives a matrix and its possible error, relative to 1 + |q|^2 + |v|^2; without it all pairs are exact.
    ``least``: no distance is less. ``infinite_last``: a vector with a component that isn't finite comes last. ``factors(x, query)`` gives
    a matrix of queries and one of rows whose product is the distances, to be taken in single precision.
    """

    exact: Callable[[np.ndarray, np.ndarray, bool], np.ndarray]
    near: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None
    least: float = -np.inf
    infinite_last: bool = False
    factors: Callable[[np.ndarray, bool], np.ndarray] | None = None


def components(v: np.ndarray, q: np.ndarray, every: bool) -> tuple[Components, tuple[int, ...]]:
    """Components of rows and queries, of each pair of them or of rows that stand side by side; and the shape of what comes out."""
    a, b = np.ascontiguousarray(v.T), np.ascontiguousarray(q.T)
    if every:
        return ((x[None, :], y[:, None]) for x, y in zip(a, b)), (len(q), len(v))
    return zip(a, b), (len(v),)


def l2(v: np.ndarray, q: np.ndarray, every: bool) -> np.ndarray:
    parts, shape = components(v, q, every)
    return fold(parts, square, shape)


def inner(v: np.ndarray, q: np.ndarray, every: bool) -> np.ndarray:
    parts, shape = components(v, q, every)
    return fold(parts, np.multiply, shape)


def norms(v: np.ndarray) -> np.ndarray:
    return fold(((x, x) for x in np.ascontiguousarray(v.T)), np.multiply, (len(v),))


def beside(v: np.ndarray, q: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """A number of each row and one of each query, shaped like their pairs."""
    return (v[None, :], q[:, None]) if every else (v, q)


def cosine(v: np.ndarray, q: np.ndarray, every: bool) -> np.ndarray:
    a, b = beside(np.sqrt(norms(v)), np.sqrt(norms(q)), every)
    both = a * b
    return np.where(both <= 0, 1.0, 1 - inner(v, q, every) / both)  # a product that is no number counts as positive, as in SQL


def fast_l2(v: np.ndarray, q: np.ndarray, every: bool) -> np.ndarray:
    return beside(norms(v), norms(q), every)[0] - 2 * inner(v, q, every)


def near_cosine(q: np.ndarray, v: np.ndarray, nq: np.ndarray, nv: np.ndarray) -> np.ndarray:
    lengths = np.sqrt(nq)[:, None] * np.sqrt(nv)[None, :]
    fair = (nq > 1e-200)[:, None] & (nv > 1e-200)[None, :]
    return np.where(fair, 1 - (q @ v.T) / lengths, np.nan)


def near_l2(q: np.ndarray, v: np.ndarray, nq: np.ndarray, nv: np.ndarray) -> np.ndarray:
    d = q @ v.T
    d *= -2
    d += nv[None, :]
    d += nq[:, None]
    return d


def l2_factors(x: np.ndarray, query: bool) -> np.ndarray:
    squares, one = (x * x).sum(axis=1), np.ones(len(x))
    return np.column_stack([-2 * x, squares, one] if query else [x, one, squares])


def cosine_factors(x: np.ndarray, query: bool) -> np.ndarray:
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    return np.column_stack([-unit if query else unit, np.ones(len(x))])


def weighted_l2(parts: list[tuple[float, int, int]]) -> Method:
    """The sum of weighted squared distances over parts (weight, first component, components)."""

    def exact(v: np.ndarray, q: np.ndarray, every: bool) -> np.ndarray:
        scores = [w * l2(v[:, at : at + n], q[:, at : at + n], every) for w, at, n in parts]
        out = scores[0]
        for more in scores[1:]:
            out = out + more
        return out

    def near(q: np.ndarray, v: np.ndarray, nq: np.ndarray, nv: np.ndarray) -> np.ndarray:
        a, b = (np.concatenate([np.sqrt(w) * x[:, at : at + n] for w, at, n in parts], axis=1) for x in (q, v))
        return near_l2(a, b, (a * a).sum(axis=1), (b * b).sum(axis=1))

    def factors(x: np.ndarray, query: bool) -> np.ndarray:
        return l2_factors(np.concatenate([np.sqrt(w) * x[:, at : at + n] for w, at, n in parts], axis=1), query)

    if any(not 0 <= w <= 1 for w, _, _ in parts):
        raise ValueError("weights must be from 0 to 1")
    return Method(exact, near, 0.0, factors=factors)


def hamming(v: np.ndarray, q: np.ndarray, every: bool) -> np.ndarray:
    if every and not ((v != 0) & (v != 1)).any() and not ((q != 0) & (q != 1)).any():
        return v.sum(axis=1)[None, :] + q.sum(axis=1)[:, None] - 2 * (q @ v.T)  # whole numbers, so exact
    parts, shape = components(v, q, every)
    return fold(parts, np.not_equal, shape)


def shared_places(v: np.ndarray, q: np.ndarray, every: bool) -> np.ndarray:
    """1 - |a & b| / |a | b| of the places of vectors that hold 1, where all others hold 0; two vectors without any are equal."""
    common = inner(v, q, every) if not every else q @ v.T  # whole numbers, so exact
    a, b = beside(v.sum(axis=1), q.sum(axis=1), every)
    either = a + b - common
    return np.where(either > 0, 1 - common / either, 0.0)


METHODS: dict[str, Method] = {
    "l2": Method(l2, near_l2, 0.0, True, l2_factors),
    "inner_product": Method(lambda v, q, every: -inner(v, q, every), lambda q, v, nq, nv: -(q @ v.T), factors=lambda x, query: -x if query else x),
    "cosine": Method(cosine, near_cosine, factors=cosine_factors),
    "cosine_of_units": Method(lambda v, q, every: 2 * cosine(v, q, every)),
    "fast_l2": Method(fast_l2),
    "euclidean": Method(lambda v, q, every: np.sqrt(l2(v, q, every)), None, 0.0),
    "hamming": Method(hamming, None, 0.0),
    "similarity": Method(lambda v, q, every: 1 - l2(v, q, every)),
}


def every_pair(how: Method, q: np.ndarray, v: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """(slice of queries, their exact distances to all rows), block by block."""
    with np.errstate(all="ignore"):
        for i in range(0, len(q), BLOCK[0]):
            at = slice(i, i + BLOCK[0])
            blocks = [how.exact(v[j : j + BLOCK[1]], q[at], True) for j in range(0, len(v), BLOCK[1])]
            if blocks:
                yield at, blocks[0] if len(blocks) == 1 else np.concatenate(blocks, axis=1)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero of x times a power of ten, as SQL's round has it."""
    with np.errstate(all="ignore"):
        scaled = x * 10.0**digits
        whole = np.trunc(scaled)
        whole = np.copysign(np.abs(whole) + (np.abs(scaled - whole) >= 0.5), scaled) / 10.0**digits
    return np.where(np.isfinite(whole), whole, x)
