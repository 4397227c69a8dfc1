"""A linear-chain conditional random field with two tags (0 clean, 1 toxic).

Emissions are sums of feature weights of a token, transitions a 2 x 2 table.
Tag 0 has emission 0, so a token's emission is the log-odds it adds. All
documents of a batch are run side by side, one token of each at a time.
"""

from __future__ import annotations

import re

import numpy as np

_LETTERS = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"\S+")


def token_features(token: str) -> list[str]:
    """Features of one token: its letters, their first 4 to 6, their last 3, its look."""
    word = "".join(_LETTERS.findall(token)).lower()
    out = [f"w={word}", f"s={word[-3:]}"]
    out += [f"p={word[:n]}" for n in (4, 5, 6) if len(word) >= n]
    if token[:1].isupper():
        out.append("upper")
    if not word:
        out.append("no letters")
    elif len(word) < len(token):
        out.append("marks")
    return out


def _softmax2(d: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(d, -500, 500)))


class Chains:
    """Tokens of several documents one after the other, with the order in which
    they are walked: longest first, so that those under way are a prefix."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        ends = np.cumsum(lengths)
        self.start = ends - lengths
        order = np.argsort(-lengths, kind="stable")
        self._first, self._last, lengths = self.start[order], ends[order] - 1, lengths[order]
        longest = int(lengths[0]) if len(lengths) else 0
        self._under_way = np.searchsorted(-lengths, -np.arange(longest), side="left")  # with more than t tokens

    def marginals(self, emission: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(tag = 1) of each token; and the forward and backward shares of tag 1."""
        x = np.exp(np.clip(emission, -30, 30))
        t = np.exp(trans)
        s = np.exp(start)
        q, b = np.empty(len(x)), np.empty(len(x))
        for step, n in enumerate(self._under_way):
            i = self._first[:n] + step
            if step:
                before = q[i - 1]
                one = ((1 - before) * t[0, 1] + before * t[1, 1]) * x[i]
                none = (1 - before) * t[0, 0] + before * t[1, 0]
            else:
                one, none = s[1] * x[i], s[0]
            q[i] = one / (one + none)
        for step, n in enumerate(self._under_way):
            i = self._last[:n] - step
            if step:
                one_after = b[i + 1] * x[i + 1]
                none_after = 1 - b[i + 1]
                one = t[1, 0] * none_after + t[1, 1] * one_after
                none = t[0, 0] * none_after + t[0, 1] * one_after
                b[i] = one / (one + none)
            else:
                b[i] = 0.5
        del x
        one = q * b
        none = (1 - q) * (1 - b)
        none += one
        one /= none
        return one, q, b


BLOCK = 1 << 18


def by_number(number: np.ndarray, weight: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``weight[place]`` by ``number``, as bincount adds them up, block by
    block: the list of all features of all types is by far the longest array."""
    out = np.zeros(n)
    for lo in range(0, len(number), BLOCK):
        np.add.at(out, number[lo:lo + BLOCK], weight[place[lo:lo + BLOCK]])
    return out


def fit(feature: np.ndarray, owner: np.ndarray, n_features: int, n_types: int, token_type: np.ndarray, tags: np.ndarray,
        lengths: np.ndarray, steps: int = 60, rate: float = 0.3, decay: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature weights, transitions, start) by gradient ascent (Adam) on the
    conditional likelihood of the tags, with an L2 penalty of ``decay``.

    ``feature`` lists the feature numbers of each type (distinct token) next to
    its number in ``owner``; ``token_type`` has the type of each token."""
    chains = Chains(lengths)
    w, trans, start = np.zeros(n_features), np.zeros((2, 2)), np.array([0.0, -2.0])
    trans[0, 1] = trans[1, 1] = -2.0
    inner = np.ones(len(tags), bool)
    inner[chains.start[lengths > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(tags[at - 1] * 2 + tags[at], minlength=4).reshape(2, 2)
    heads = tags[~inner]
    params = [w, trans, start]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        emission = by_number(owner, w, feature, n_types)[token_type]
        p, q, b = chains.marginals(emission, trans, start)
        by_type = np.bincount(token_type, weights=tags - p, minlength=n_types)
        gw = by_number(feature, by_type, owner, n_features) - decay * w
        x, t = np.exp(np.clip(emission[at], -30, 30)), np.exp(trans)
        del emission
        before, after = q[at - 1], b[at]
        del q, b
        joint = [(1 - before) * t[0, 0] * (1 - after), (1 - before) * t[0, 1] * x * after,
                 before * t[1, 0] * (1 - after), before * t[1, 1] * x * after]
        del x, before, after
        every = joint[0] + joint[1]
        every += joint[2]
        every += joint[3]
        for part in joint:
            part /= every
        expected = np.array([part.sum() for part in joint]).reshape(2, 2)
        del joint, every
        p0 = p[~inner]
        gs = np.array([(p0 - heads).sum(), (heads - p0).sum()])
        for k, g in enumerate((gw, seen - expected, gs)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] += rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return w, trans, start
