"""A linear-chain conditional random field: batched forward-backward and its training.

Chains are given one behind the other; all chains of a batch advance together, longest first, so
a step works on a matrix. Sums are scaled at every step and need no logarithms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Chain:
    """Scores that do not depend on the input: first state, and next state given this one."""

    start: np.ndarray
    move: np.ndarray

    @staticmethod
    def flat(states: int) -> Chain:
        return Chain(np.zeros(states), np.zeros((states, states)))


def forward_backward(emit: np.ndarray, lengths: np.ndarray, chain: Chain, count_moves: bool = False):
    """Marginals (positions, states), log of the normalisers' sum, expected moves and first states.

    ``emit`` holds the scores of all positions, ``lengths`` how many belong to each chain in turn.
    """
    total, states = emit.shape
    lengths = np.asarray(lengths)
    begin = np.cumsum(lengths) - lengths
    lengths, begin = lengths[lengths > 0], begin[lengths > 0]
    order = np.argsort(-lengths, kind="stable")
    lengths, begin = lengths[order], begin[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains longer than t
    top = emit.max(axis=1, keepdims=True) if total else emit
    weight = np.exp(emit - top)
    move, start = np.exp(chain.move), np.exp(chain.start)
    alpha = np.empty((total, states))
    log_sum = float(top.sum())
    state = None
    for t in range(longest):
        at = begin[: active[t]] + t
        state = weight[at] * (start if t == 0 else state[: active[t]] @ move)
        scale = state.sum(axis=1, keepdims=True)
        state = state / scale
        alpha[at] = state
        if count_moves:
            log_sum += float(np.log(scale).sum())
    moves = np.zeros((states, states))
    marginal = np.empty((total, states))
    back = np.ones((len(lengths), states))  # of the chains that go on behind t, scaled
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        if t + 1 < longest and active[t + 1]:
            m = active[t + 1]
            ahead = weight[begin[:m] + t + 1] * back[:m]
            if count_moves:
                scale = ((alpha[begin[:m] + t] @ move) * ahead).sum(axis=1, keepdims=True)
                moves += move * ((alpha[begin[:m] + t] / scale).T @ ahead)
            ahead = ahead @ move.T
            back[:m] = ahead / ahead.sum(axis=1, keepdims=True)
        p = alpha[at] * back[:n]
        marginal[at] = p / p.sum(axis=1, keepdims=True)
    first = marginal[begin].sum(axis=0) if len(begin) else np.zeros(states)
    return marginal, log_sum, moves, first


def gold_counts(labels: np.ndarray, lengths: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray]:
    """Moves and first states of given labels."""
    lengths = np.asarray(lengths)
    ends = np.cumsum(lengths)
    inner = np.ones(len(labels), dtype=bool)
    inner[(ends - lengths)[lengths > 0]] = False
    at = np.flatnonzero(inner)
    moves = np.zeros((states, states))
    np.add.at(moves, (labels[at - 1], labels[at]), 1)
    return moves, np.bincount(labels[~inner], minlength=states).astype(float)


class Adam:
    """Gradient steps of an adapted size for a few arrays."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.mean = [np.zeros_like(a) for a in arrays]
        self.square = [np.zeros_like(a) for a in arrays]

    def ascend(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, s in zip(self.arrays, gradients, self.mean, self.square, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            a += self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8)
