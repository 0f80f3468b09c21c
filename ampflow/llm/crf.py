"""Linear-chain conditional random field over blocks of many chains.

Chains lie one after another in one array.  Each is cut into segments, all
segments advance together one item at a time, and the segments of a chain are
joined through their transfer matrices; so the marginals are exact, and a very
long chain costs no more an item than a short one.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 64


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def forward_backward(scores: np.ndarray, starts: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Marginals of every item, by forward-backward.

    ``scores`` (items, labels) are log potentials, ``starts`` the first item of
    each chain (none is empty), ``trans`` (labels, labels) the log potentials of
    a label after another.  With ``pairs``, also the expected number of each
    pair of neighbouring labels.
    """
    n, k = scores.shape
    if not n:
        return (np.zeros((0, k)), np.zeros((k, k))) if pairs else np.zeros((0, k))
    e = np.exp(scores - scores.max(1, keepdims=True)) + 1e-30
    t = np.exp(trans - trans.max()) + 1e-12
    starts = np.asarray(starts, dtype=np.int64)
    ends = np.append(starts[1:], n)
    count = -(-(ends - starts) // SEGMENT)
    first = np.cumsum(count) - count
    chain = np.repeat(np.arange(len(starts)), count)
    rank = np.arange(len(chain)) - first[chain]
    at = starts[chain] + rank * SEGMENT
    length = np.minimum(SEGMENT, ends[chain] - at)

    order = np.argsort(-length, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    at, length, head = at[order], length[order], (rank == 0)[order]
    active = [int(np.searchsorted(-length, -s, "left")) for s in range(SEGMENT)]  # segments longer than s

    ahead = np.ones((len(order), k))  # message into a segment from before it
    behind = np.ones((len(order), k))  # and from after it
    long = np.nonzero(count > 1)[0]
    if len(long):
        sub = np.nonzero((count > 1)[chain][order])[0]
        where = np.full(len(order), -1)
        where[sub] = np.arange(len(sub))
        a, size = at[sub], length[sub]
        p = np.where(head[sub][:, None, None], np.eye(k), t) * e[a][:, None, :]
        for s in range(1, SEGMENT):
            c = int(np.searchsorted(-size, -s, "left"))
            if not c:
                break
            p[:c] = (p[:c].reshape(-1, k) @ t).reshape(c, k, k) * e[a[:c] + s][:, None, :]
            if s % 4 == 0:
                p[:c] /= p[:c].max((1, 2), keepdims=True)
        p /= p.max((1, 2), keepdims=True)
        msg = np.ones((len(long), k))
        for s in range(int(count.max())):
            live = count[long] > s
            seg = place[first[long[live]] + s]
            ahead[seg] = msg[live]
            msg[live] = _unit(np.einsum("ci,cij->cj", msg[live], p[where[seg]]) + 1e-300)
        msg = np.ones((len(long), k))
        for s in range(int(count.max()) - 1, -1, -1):
            live = count[long] > s
            seg = place[first[long[live]] + s]
            behind[seg] = msg[live]
            msg[live] = _unit(np.einsum("cij,cj->ci", p[where[seg]], msg[live]) + 1e-300)

    alpha, beta = np.empty((n, k)), np.empty((n, k))
    v = _unit(np.where(head[:, None], 1.0, ahead @ t) * e[at])
    alpha[at] = v
    for s in range(1, SEGMENT):
        if not (c := active[s]):
            break
        v = _unit((v[:c] @ t) * e[at[:c] + s])
        alpha[at[:c] + s] = v
    for s in range(SEGMENT - 1, -1, -1):
        c = active[s]
        if s + 1 < SEGMENT and (d := active[s + 1]):
            behind[:d] = _unit((e[at[:d] + s + 1] * behind[:d]) @ t.T)
        if c:
            beta[at[:c] + s] = behind[:c]
    marginals = _unit(alpha * beta)
    if not pairs:
        return marginals
    inner = np.ones(n, bool)
    inner[starts] = False
    i = np.nonzero(inner)[0]
    xi = alpha[i - 1][:, :, None] * t * (e[i] * beta[i])[:, None, :]
    xi /= xi.sum((1, 2), keepdims=True)
    return marginals, xi.sum(0)


def observed_pairs(gold: np.ndarray, starts: np.ndarray, labels: int) -> np.ndarray:
    """How often each pair of neighbouring labels occurs."""
    inner = np.ones(len(gold), bool)
    inner[starts] = False
    i = np.nonzero(inner)[0]
    out = np.zeros((labels, labels))
    np.add.at(out, (gold[i - 1], gold[i]), 1)
    return out


class Adam:
    """Gradient ascent with moment estimates, in place."""

    def __init__(self, *arrays: np.ndarray, rate: float):
        self.arrays, self.rate, self.step = arrays, rate, 0
        self.m = [np.zeros_like(x) for x in arrays]
        self.v = [np.zeros_like(x) for x in arrays]

    def up(self, *grads: np.ndarray) -> None:
        self.step += 1
        for x, g, m, v in zip(self.arrays, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-8)
