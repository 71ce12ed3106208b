"""Linear-chain conditional random fields in numpy: training, forward-backward, Viterbi.

A model has a weight for each (feature, label) and each (label, next label).
Features of a token are rows of the weight table; a token's score for a label is
the sum of its rows. Sequences are laid end to end, ``first`` marking where each
begins; no transition counts there.
"""

from __future__ import annotations

import numpy as np


def scores(weights: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(tokens, labels): sums of the weights' rows; token i has rows[starts[i]:starts[i + 1]], one at least."""
    return np.add.reduceat(weights[rows], starts, axis=0) if len(starts) else np.zeros((0, weights.shape[1]), weights.dtype)


def posteriors(score: np.ndarray, transitions: np.ndarray, first: np.ndarray, block: int = 64) -> np.ndarray:
    """(tokens, labels): forward-backward marginals of all sequences at once."""
    return _messages(score, transitions, first, block)[1]


def _messages(score: np.ndarray, transitions: np.ndarray, first: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(forward messages, marginals) of each token.

    A step is a matrix, transition times emission; the first step of a sequence has
    equal rows, which forget what came before. Matrices are multiplied inside
    blocks (all blocks at once), messages then pass from block to block, and at
    last through every block at once, so numpy's loops are as long as a block.
    """
    n, labels = score.shape
    if not n:
        return np.zeros((0, labels)), np.zeros((0, labels))
    emit = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float64)
    step = np.where(first[:, None, None], emit[:, None, :], np.exp(transitions)[None] * emit[:, None, :])
    blocks = -(-n // block)
    pad = np.broadcast_to(np.eye(labels), (blocks * block - n, labels, labels))
    step = np.ascontiguousarray(np.concatenate([step, pad]).reshape(blocks, block, labels, labels).swapaxes(0, 1))
    whole = step[0]
    for t in range(1, block):
        whole = whole @ step[t]
        whole = whole / whole.max(axis=(1, 2), keepdims=True)
    into, after = np.empty((blocks, labels)), np.empty((blocks, labels))
    a = b = np.full(labels, 1 / labels)
    for k in range(blocks):
        into[k] = a
        a = a @ whole[k]
        a = a / a.sum()
    for k in range(blocks - 1, -1, -1):
        after[k] = b
        b = whole[k] @ b
        b = b / b.sum()
    ahead, back = np.empty((block, blocks, labels)), after
    a = into
    for t in range(block):
        a = np.einsum("bi,bij->bj", a, step[t])
        a = a / a.sum(axis=1, keepdims=True)
        ahead[t] = a
    forward = ahead.swapaxes(0, 1).reshape(-1, labels)[:n].copy()
    for t in range(block - 1, -1, -1):
        ahead[t] *= back
        back = np.einsum("bij,bj->bi", step[t], back)
        back = back / back.sum(axis=1, keepdims=True)
    out = ahead.swapaxes(0, 1).reshape(-1, labels)[:n]
    return forward, out / out.sum(axis=1, keepdims=True)


def viterbi(score: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best label of every token; sequences of about one length are decoded together."""
    out = np.zeros(len(score), np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    order = np.argsort(lengths, kind="stable")
    for low in range(0, len(order), 256):
        some = order[low : low + 256]
        size, longest = lengths[some], int(lengths[some].max(initial=0))
        if not longest:
            continue
        # aligned at their ends: shorter ones begin later
        begin = longest - size
        at = starts[some] - begin
        best, back = np.zeros((len(some), score.shape[1])), np.zeros((longest, len(some), score.shape[1]), np.int8)
        for t in range(longest):
            live = t >= begin
            here = score[np.where(live, at + t, 0)]
            ways = best[:, :, None] + transitions[None]
            came = ways.argmax(axis=1)
            reached = np.take_along_axis(ways, came[:, None, :], 1)[:, 0]
            best = np.where(live[:, None], np.where((t > begin)[:, None], reached, 0) + here, 0)
            back[t] = came
        label = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            live = t >= begin
            out[(at + t)[live]] = label[live]
            label = np.where(live & (t > begin), back[t, np.arange(len(some)), label], label)
    return out


def trained(
    rows: list[np.ndarray], labels: np.ndarray, first: np.ndarray, features: int, kinds: int, rounds: int = 6, batch: int = 4096, rate: float = 0.2, decay: float = 1e-6,
    barred: np.ndarray | None = None, steps: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) that raise the conditional likelihood, by AdaGrad on runs of whole sequences.

    ``rows[i]``: the feature rows of token i. ``barred`` (tokens, labels) and ``steps``
    (labels, labels) are added to the scores and begin the transitions: large negative
    values forbid. The order of the runs is fixed, so a model is the same wherever it
    is trained.
    """
    w, t = np.zeros((features, kinds)), np.zeros((kinds, kinds)) if steps is None else steps.copy()
    gw, gt = np.full((features, kinds), 1e-8), np.full((kinds, kinds), 1e-8)
    heads = np.flatnonzero(first)
    cuts, last = [0], 0
    for h in [*heads[1:], len(labels)]:
        if h - last >= batch or h == len(labels):
            cuts.append(int(h))
            last = h
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for k in rng.permutation(len(cuts) - 1):
            part = slice(cuts[k], cuts[k + 1])
            y, f = labels[part], first[part]
            sizes = np.array([len(r) for r in rows[part]])
            flat, starts = np.concatenate(rows[part]), np.concatenate([[0], np.cumsum(sizes)])[:-1]
            score = scores(w, flat, starts) + (0 if barred is None else barred[part])
            ahead, p = _messages(score, t, f)
            wrong = -p
            wrong[np.arange(len(y)), y] += 1
            grad = np.zeros_like(w)
            np.add.at(grad, flat, np.repeat(wrong, sizes, axis=0))
            grad -= decay * len(y) * w
            gw += grad**2
            w += rate * grad / np.sqrt(gw)
            inside = ~f[1:]
            seen = np.zeros_like(t)
            np.add.at(seen, (y[:-1][inside], y[1:][inside]), 1)
            grad = seen - _expected_pairs(score, t, f, ahead, p)
            gt += grad**2
            t += rate * grad / np.sqrt(gt)
    return w, t


def _expected_pairs(score: np.ndarray, t: np.ndarray, first: np.ndarray, ahead: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected transition counts: the pair (i-1, i) is ahead[i-1] transition emission[i] backward[i]."""
    inside = np.flatnonzero(~first)
    if not len(inside):
        return np.zeros_like(t)
    emit = np.exp(score[inside] - score[inside].max(axis=1, keepdims=True))
    back = p[inside] / np.maximum(ahead[inside], 1e-300)
    pair = ahead[inside - 1][:, :, None] * np.exp(t)[None] * (emit * back)[:, None, :]
    return (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
