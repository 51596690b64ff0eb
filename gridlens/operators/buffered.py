"""The step detector and the settled level over bounded buffers of rows, for stateful streaming operators.

The rules are those of `steps.detect_steps` and `windows.settled_windows`; a buffer is some seconds of one series.
"""

from __future__ import annotations

import math

import numpy as np

from .steps import StepRules
from .windows import odd_width


def _framed(values: np.ndarray, before: int, after: int, beyond: float) -> np.ndarray:
    """A row for each position with the values from `before` before it to `after` after it."""
    wide = np.concatenate([np.full(before, beyond), values, np.full(after, beyond)])
    return np.lib.stride_tricks.sliding_window_view(wide, before + after + 1)


def _noise(off: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Sample deviation over k centred rows of a buffer, the next one there is where fewer than three rows are, else the
    last. own: each position's buffer, -1 between buffers."""
    ahead = (k - 1) // 2
    frames = _framed(np.where(own >= 0, off, np.nan), k - 1 - ahead, ahead, np.nan)
    there = np.isfinite(frames)
    n = there.sum(axis=1)
    enough = (own >= 0) & (n >= 3)
    out = np.full(len(off), np.nan)
    if not enough.any():
        return out
    some, there, n = frames[enough], there[enough], n[enough]
    centred = np.where(there, some - (np.where(there, some, 0.0).sum(axis=1) / n)[:, None], 0.0)
    out[enough] = np.sqrt((centred**2).sum(axis=1) / (n - 1))
    lacking, at = np.flatnonzero((own >= 0) & ~enough), np.flatnonzero(enough)
    if len(lacking):
        after = np.searchsorted(at, lacking)
        following, last = at[np.minimum(after, len(at) - 1)], at[np.maximum(after - 1, 0)]
        near = np.where(own[following] == own[lacking], following, last)
        out[lacking] = np.where(own[near] == own[lacking], out[near], np.nan)
    return out


def steps_of_buffers(sizes: np.ndarray, t: np.ndarray, p: np.ndarray, q: np.ndarray, thd: np.ndarray, rules: StepRules = StepRules(), after: np.ndarray | float = -math.inf, upto: np.ndarray | float = math.inf) -> tuple[np.ndarray, np.ndarray]:
    """(buffer of each step, its t_sec, delta_p, delta_q, p_before, p_after, thd_i_after) of buffers that lie behind each
    other, `sizes` rows each in order of time: those with after < t_sec <= upto of their buffer. p and q have no gaps;
    thd is NaN where it is missing."""
    w, k = rules.w, int(rules.noise_s * rules.sps)
    width = odd_width(rules.smooth_s, rules.sps)
    gap = 2 * w + max(width, k)
    sizes = np.asarray(sizes, np.int64)
    after, upto = (np.broadcast_to(np.asarray(x, float), len(sizes)) for x in (after, upto))
    none = np.zeros(0, np.int64), np.zeros((0, 6))
    if not (sizes > 2 * w).any():
        return none
    # gaps between the buffers, wider than any frame
    begin = gap + np.concatenate([[0], np.cumsum(sizes[:-1] + gap)]).astype(np.int64)
    rows = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64), sizes) + np.arange(len(t))
    length = int(begin[-1] + sizes[-1] + gap)
    spread = lambda x, beyond: _spread(x, rows, length, beyond)
    t, p, q, thd = spread(t, np.nan), spread(p, 0.0), spread(q, 0.0), spread(thd, np.nan)
    own = _spread(np.repeat(np.arange(len(sizes)), sizes), rows, length, -1)
    ps, qs = (np.where(own >= 0, _framed(x, width // 2, width // 2, 0.0).sum(axis=1) / width, 0.0) for x in (p, q))
    noise = _noise(p - ps, own, k)
    at = np.arange(length) - np.where(own >= 0, begin[own], 0)
    inner = np.flatnonzero((own >= 0) & (at >= w) & (at < sizes[own] - w))
    means = lambda x: np.lib.stride_tricks.sliding_window_view(x, w).sum(axis=1) / w

    def change(x: np.ndarray) -> np.ndarray:
        m = means(x)
        return m[inner] - m[inner - w]

    diff_p, diff_q = change(ps), change(qs)
    bar = np.maximum(rules.floor_w, rules.k_noise * np.nan_to_num(noise[inner]) * math.sqrt(2.0 / w))
    above = (np.abs(diff_p) >= bar) | (np.abs(diff_q) >= rules.q_floor)
    marked, force = inner[above], np.hypot(diff_p[above], diff_q[above])
    if not len(marked):
        return none
    run = np.cumsum(np.concatenate([[True], np.diff(marked) > 1])) - 1
    most = np.maximum.reduceat(force, np.searchsorted(run, np.arange(run[-1] + 1)))
    _, first = np.unique(run[force == most[run]], return_index=True)
    k = marked[force == most[run]][first]
    # a step begins in the 2w rows up to its k
    k = k[(t[k] > after[own[k]]) & (t[np.maximum(k - 2 * w, begin[own[k]])] <= upto[own[k]])]
    if not len(k):
        return none
    around = lambda x, lo, hi: x[k[:, None] + np.arange(lo, hi)]
    median = lambda x, lo, hi: np.median(around(x, lo, hi), axis=1)
    before, level = median(p, -w, 0), median(p, 0, w)
    dp, dq = level - before, median(q, 0, w) - median(q, -w, 0)
    moves = np.abs(dp) > 1e-6
    lasts = ~moves | (at[k] + 2 * w > sizes[own[k]]) | (np.abs(median(p, w, 2 * w) - level) <= rules.sustain * np.abs(dp))
    stays = ((np.abs(dp) >= rules.floor_w) | (np.abs(dq) >= rules.q_floor)) & lasts
    with np.errstate(divide="ignore", invalid="ignore"):
        low = ((around(p, 1 - 2 * w, 1) - before[:, None]) / dp[:, None] < 0.5) & (at[k][:, None] + np.arange(1 - 2 * w, 1) > 0)
    onset = k - np.where(low.any(axis=1), np.argmax(low[:, ::-1], axis=1), w)
    onset = np.where(moves, onset, k)
    known = np.where(np.isfinite(around(thd, 0, w)), around(thd, 0, w), np.nan)
    distortion = np.full(len(k), np.nan)
    some = np.isfinite(known).any(axis=1)
    if some.any():
        distortion[some] = np.nanmedian(known[some], axis=1)
    stays &= (t[onset] > after[own[k]]) & (t[onset] <= upto[own[k]])
    return own[k][stays], np.column_stack([t[onset], dp, dq, before, level, distortion])[stays]


def _spread(x: np.ndarray, rows: np.ndarray, length: int, beyond) -> np.ndarray:
    out = np.full(length, beyond, x.dtype if beyond == -1 else float)
    out[rows] = x
    return out


def buffer_steps(t: np.ndarray, p: np.ndarray, q: np.ndarray, thd: np.ndarray, rules: StepRules = StepRules()) -> list[tuple]:
    """(t_sec, delta_p, delta_q, p_before, p_after, thd_i_after or None) of the steps of rows in order of time.
    p and q have no gaps; thd is NaN where it is missing."""
    _, found = steps_of_buffers(np.array([len(t)]), t, p, q, thd, rules)
    return [(*map(float, s[:5]), None if math.isnan(s[5]) else float(s[5])) for s in found]


def first_level(t: np.ndarray, p: np.ndarray, q: np.ndarray, thd: np.ndarray, since: float, seconds: float, until: float, least: float = 1.5, share: float = 0.02) -> tuple | None:
    """(t_sec, P, Q, thd or None): medians over the first window of `seconds` that is settled, begins no earlier
    than `since` and ends by `until`; None if there is none."""
    for i in np.flatnonzero((t >= since + seconds) & (t <= until)):
        own = (t >= t[i] - seconds) & (t <= t[i])
        s = np.hypot(p[own], q[own])
        if any(np.std(x) <= max(least, share * max(abs(np.mean(x)), 1.0)) for x in (p[own], s)):
            known = thd[own][np.isfinite(thd[own])]
            return float(t[i]), float(np.median(p[own])), float(np.median(q[own])), float(np.median(known)) if len(known) else None
    return None
