"""Scores of all names of one side with all names of the other, in blocks of equal lengths.

Within a block every pair has the same two lengths, so nothing is padded: the masks of a short name's characters are looked up once for each character of the long names, the
sets of a subsequence take the smallest integers that hold them, and one addition updates all pairs. The results are those of ``similarity`` and ``scoring.ruled``.
"""

from __future__ import annotations

import numpy as np

from . import similarity
from . import vocab as V

#: Names of one length that are scored together, and pairs of a block.
STRIP, PAIRS = 64, 1 << 15


def _sets(m: int) -> type:
    return np.uint8 if m <= 8 else np.uint16 if m <= 16 else np.uint32 if m <= 32 else np.uint64


def _codes(texts: list[str]) -> np.ndarray:
    """Rows of code points of strings of one length."""
    m = len(texts[0])
    return np.array(texts, f"<U{m}").view(np.uint32).reshape(len(texts), m)


class Texts:
    """Distinct strings by length: (length, their places, their code points)."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        self.groups = [(int(m), at := np.flatnonzero(n == m), _codes([texts[i] for i in at]) if m else None) for m in np.unique(n)]


def _masks(short: np.ndarray, long: np.ndarray, backwards: bool = False) -> np.ndarray:
    """(place, short name, long name): the bits of the short name that equal the long name's character there; ``backwards`` for both read from their ends."""
    m = short.shape[1]
    kind = _sets(m)
    known, where = np.unique(short, return_inverse=True)
    where = where.reshape(short.shape)
    table = np.zeros((len(short), len(known) + 1), kind)
    row = np.arange(len(short))
    for i in range(m):
        table[row, where[:, i]] |= kind(1 << (m - 1 - i if backwards else i))
    at = np.minimum(np.searchsorted(known, long), len(known) - 1)
    at = np.where(known[at] == long, at, len(known))
    at = at[:, ::-1] if backwards else at
    return np.ascontiguousarray(np.take(table, at.T, axis=1).transpose(1, 0, 2))


class _Walk:
    """Common subsequences of all pairs of a block, one place of the long names after the other."""

    def __init__(self, m: int, shape: tuple[int, int]):
        self.kind = _sets(m)
        self.full = self.kind((1 << m) - 1)
        self.v, self.u, self.w = (np.empty(shape, self.kind) for _ in range(3))
        self.start()

    def start(self) -> None:
        self.v.fill(~self.kind(0))

    def step(self, mask: np.ndarray) -> None:
        np.bitwise_and(self.v, mask, out=self.u)
        np.add(self.v, self.u, out=self.w)
        np.subtract(self.v, self.u, out=self.v)
        np.bitwise_or(self.v, self.w, out=self.v)

    def common(self) -> np.ndarray:
        np.bitwise_not(self.v, out=self.w)
        np.bitwise_and(self.w, self.full, out=self.w)
        return np.bitwise_count(self.w)


def _lcs_block(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    walk = _Walk(short.shape[1], (len(short), len(long)))
    for mask in _masks(short, long):
        walk.step(mask)
    return walk.common().astype(np.int16)


def _windows_block(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common subsequences of the whole strings, and the best ratio of the short ones with the windows of the long ones, those cut off at either end included."""
    m, n = short.shape[1], long.shape[1]
    masks = _masks(short, long)
    walk = _Walk(m, (len(short), len(long)))
    most = np.zeros((m + 1, len(short), len(long)), np.uint8)  # by the length of the window
    for j in range(n):
        walk.step(masks[j])
        if j < m:
            most[j + 1] = walk.common()
    whole = walk.common().astype(np.int16)
    for k in range(1, n - m + 1):
        walk.start()
        for j in range(k, k + m):
            walk.step(masks[j])
        np.maximum(most[m], walk.common(), out=most[m])
    walk.start()
    for j, mask in enumerate(_masks(short, long[:, n - m + 1 :], True) if m > 1 else ()):
        walk.step(mask)
        np.maximum(most[j + 1], walk.common(), out=most[j + 1])
    best = np.zeros(whole.shape)
    for length in range(1, m + 1):
        np.maximum(best, 200.0 * most[length] / (m + length), out=best)
    return whole, best


def _same_start(short: np.ndarray, long: np.ndarray, backwards: bool = False) -> np.ndarray:
    out, alive = np.zeros((len(short), len(long)), np.int16), np.ones((len(short), len(long)), bool)
    for j in range(short.shape[1]):
        alive &= short[:, -1 - j if backwards else j][:, None] == long[:, -1 - j if backwards else j]
        if not alive.any():
            break
        out += alive
    return out


def _blocks(a: Texts, b: Texts):
    """(places in a, places in b, short codes, long codes, whether a is the short side), in blocks of bounded size; empty strings and those over 64 on both sides are left out."""
    for m, rows, x in a.groups:
        for n, columns, y in b.groups:
            if not m or not n or min(m, n) > 64:
                continue
            for lo in range(0, len(rows), STRIP):
                wide = max(1, PAIRS // min(STRIP, len(rows) - lo))
                for left in range(0, len(columns), wide):
                    p, q = slice(lo, lo + STRIP), slice(left, left + wide)
                    yield (rows[p], columns[q], x[p], y[q], True) if m <= n else (rows[p], columns[q], y[q], x[p], False)


def _long_pairs(a: Texts, b: Texts):
    """Pairs of which both strings have over 64 characters."""
    for m, rows, _ in a.groups:
        for n, columns, _ in b.groups:
            if min(m, n) > 64:
                yield from ((i, j) for i in rows for j in columns)


def lcs(a: Texts, b: Texts) -> np.ndarray:
    out = np.zeros((len(a.texts), len(b.texts)), np.int32)
    for rows, columns, short, long, a_short in _blocks(a, b):
        got = _lcs_block(short, long)
        out[np.ix_(rows, columns)] = got if a_short else got.T
    for i, j in _long_pairs(a, b):
        out[i, j] = similarity.lcs_long(a.texts[i], b.texts[j])
    return out


def _lengths(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(map(len, a), np.int64, len(a))[:, None], np.fromiter(map(len, b), np.int64, len(b))[None, :]


def _ratios(common: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    total = nx + ny
    return np.where(total == 0, 100.0, 200.0 * common / np.maximum(total, 1))


def _distinct(texts: list[str]) -> tuple[list[str], np.ndarray]:
    number: dict[str, int] = {}
    at = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
    return list(number), at


def _spread(x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return x if len(rows) == x.shape[0] and len(columns) == x.shape[1] else x[rows][:, columns]


def _factors(common: np.ndarray, nx: np.ndarray, ny: np.ndarray, head: np.ndarray, tail: np.ndarray, two_held: np.ndarray) -> np.ndarray:
    """``similarity._view_factors``: what lies between a common start and a common end has their common subsequence less both ends."""
    shared = np.minimum(nx, ny)
    mine, other = (np.where(shared > 0, n - head - tail, 0) for n in (nx, ny))
    few, many = np.minimum(mine, other), np.maximum(mine, other)
    inner = common - head - tail
    same = 200.0 * inner / np.maximum(few + many, 1)
    held = ((few == 1) & (inner == 1)) | two_held
    out = np.where((few > 0) & (many > 1), np.select([held | (same >= V.CORE_KEEP), same >= V.CORE_MILD], [1.0, V.PENALTY_MILD], V.PENALTY_HEAVY), 1.0)
    out[(few == 0) & (many == 2)] = V.PENALTY_TWO
    out[(few == 0) & (many > 2)] = V.PENALTY_LONG
    return out


def _view(a: Texts, b: Texts, windows: bool) -> dict[str, np.ndarray]:
    """Of all pairs: the common subsequence, common start and end (whole, and beside the start), the factor of this view; with ``windows`` also the partial ratio."""
    shape = len(a.texts), len(b.texts)
    nx, ny = _lengths(a.texts, b.texts)
    out = {k: np.zeros(shape, np.int32) for k in ("common", "head", "end")} | {"two": np.zeros(shape, bool)}
    if windows:
        out["partial"] = np.where((nx == 0) & (ny == 0), 100.0, 0.0)
    for rows, columns, short, long, a_short in _blocks(a, b):
        at = np.ix_(rows, columns)
        m, n = short.shape[1], long.shape[1]
        if windows:
            common, best = _windows_block(short, long)
            if m == n:
                best = np.maximum(best, _windows_block(long, short)[1].T)
            out["partial"][at] = best if a_short else best.T
        else:
            common = _lcs_block(short, long)
        head, end = _same_start(short, long), _same_start(short, long, True)
        tail = np.minimum(end, m - head)
        s, l = np.nonzero((m - head - tail == 2) & (common - head - tail == 2) & (n > m))
        two = np.zeros(common.shape, bool)
        if len(s):  # two characters in order: whether they are neighbours in the long part
            first = head[s, l].astype(np.int64)
            begin, stop = first[:, None], (n - tail[s, l])[:, None]
            place = np.arange(n - 1)
            part = long[l]
            hit = (part[:, :-1] == short[s, first][:, None]) & (part[:, 1:] == short[s, first + 1][:, None]) & (place >= begin) & (place + 1 < stop)
            two[s, l] = hit.any(1)
        for key, x in (("common", common), ("head", head), ("end", end), ("two", two)):
            out[key][at] = x if a_short else x.T
    for i, j in _long_pairs(a, b):
        x, y = a.texts[i], b.texts[j]
        out["common"][i, j] = similarity.lcs_long(x, y)
        for key, step in (("head", 1), ("end", -1)):
            out[key][i, j] = next((k for k, (p, q) in enumerate(zip(x[::step], y[::step])) if p != q), min(len(x), len(y)))
        head = out["head"][i, j]
        tail = min(out["end"][i, j], min(len(x), len(y)) - head)
        inner = sorted((x[head : len(x) - tail], y[head : len(y) - tail]), key=len)
        out["two"][i, j] = len(inner[0]) == 2 and inner[0] in inner[1]
        if windows:
            out["partial"][i, j] = similarity.partial_ratio([x], [y])[0]
    tail = np.minimum(out["end"], np.minimum(nx, ny) - out["head"])
    out["factor"] = _factors(out["common"], nx, ny, out["head"], tail, out["two"])
    return out


#: What is needed of a name besides its key.
PARTS = ("clean", "core", "bare", "fold", "protected", "industry")


def _equal(a: list[str], b: list[str], filled: bool = False) -> np.ndarray:
    number: dict[str, int] = {}
    x, y = (np.fromiter((number.setdefault(t, len(number)) for t in side), np.int64, len(side)) for side in (a, b))
    same = x[:, None] == y
    return same & np.fromiter(map(bool, a), bool, len(a))[:, None] if filled else same


class Side:
    """Names of one side, as lists of their parts, with what does not depend on the other side."""

    def __init__(self, parts: dict[str, list[str]]):
        self.parts = parts
        self.views = {k: (Texts(distinct[0]), distinct[1]) for k in ("clean", "core", "bare") if k in parts for distinct in [_distinct(parts[k])]}
        if "industry" in parts:
            self.had_line = np.fromiter((p != q for p, q in zip(parts["industry"], parts["fold"])), bool, len(parts["fold"]))


def ratios(a: Side, b: Side, part: str = "clean") -> np.ndarray:
    """Ratio of every name of ``a`` with every one of ``b``."""
    (x, to_x), (y, to_y) = a.views[part], b.views[part]
    return _ratios(_spread(lcs(x, y), to_x, to_y), *_lengths(a.parts[part], b.parts[part]))


def scores(a: Side, b: Side, weights: dict[str, float], penalty_from: float = 0.0) -> np.ndarray:
    """Scores of all names of ``a`` with all of ``b`` as ``scoring.score_pairs`` makes them. ``weights``: of ratio, partial, wratio and core."""
    p, q = a.parts, b.parts
    nx, ny = _lengths(p["clean"], q["clean"])
    (x, to_x), (y, to_y) = a.views["clean"], b.views["clean"]
    view = {k: _spread(v, to_x, to_y) for k, v in _view(x, y, True).items()}
    ratio, partial = _ratios(view["common"], nx, ny), view["partial"]
    few, many = np.minimum(nx, ny), np.maximum(nx, ny)
    times = many / np.maximum(few, 1).astype(float)
    scaled = np.maximum(ratio, partial * np.where(times <= 8, 0.9, 0.6))
    measures = {"ratio": ratio, "partial": partial, "wratio": np.where(few == 0, 0.0, np.where(times < 1.5, ratio, scaled))}
    if "core" in weights:
        measures["core"] = ratios(a, b, "core")
    (x, to_x), (y, to_y) = a.views["bare"], b.views["bare"]
    bare = _spread(_view(x, y, False)["factor"], to_x, to_y)
    penalty = np.where(_equal(p["bare"], q["bare"]), 1.0, np.minimum(view["factor"], bare))
    base = np.zeros(ratio.shape)
    for k, w in weights.items():
        base = base + measures[k] * w
    score = base * (penalty if penalty_from <= 0 else np.where(base >= penalty_from, penalty, 1.0))
    score = np.where(_equal(p["fold"], q["fold"], True), np.maximum(score, V.SAME_FOLD_SCORE), score)
    related = _equal(p["industry"], q["industry"], True) & a.had_line[:, None] & b.had_line & (score < V.INDUSTRY_BELOW)
    score = np.where(related, np.minimum(score * V.INDUSTRY_FACTOR, V.INDUSTRY_TOP), score)
    score = np.where(_equal(p["protected"], q["protected"]), score, np.minimum(score * V.CONFLICT_FACTOR, V.CONFLICT_TOP))
    # a name lies in a longer one where a window is like it throughout
    edge = (view["head"] == few) | (view["end"] == few)
    lifted = 100.0 - (1.0 - few / np.maximum(many, 1)) * np.where(edge, V.CONTAINED_EDGE, V.CONTAINED_INSIDE)
    lifted = np.where(few <= V.CONTAINED_SHORT_LENGTH, np.maximum(lifted, V.CONTAINED_SHORT), lifted)
    score = np.where((few >= V.CONTAINED_LEAST_LENGTH) & (few < many) & (partial >= 100), np.maximum(score, lifted), score)
    score = np.where(_equal(p["core"], q["core"], True) | _equal(p["clean"], q["clean"], True), 100.0, score)
    return np.where(many > 0, np.rint(np.clip(score, 0.0, 100.0) * 10000) / 10000, 0.0)
