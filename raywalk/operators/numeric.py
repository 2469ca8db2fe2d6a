"""The numeric kernels of a chunk: embedding, projection, crossings, densities, edges. Plain numpy, no Spark."""

from __future__ import annotations

import math

import numpy as np


def sliding_sums(values: np.ndarray, width: int) -> np.ndarray:
    """All complete sums of ``width`` values, from running sums centred on the mean so that they stay small."""
    if len(values) < width:
        return np.zeros(0)
    middle = values.mean()
    total = np.concatenate([[0.0], np.cumsum(values - middle)])
    return total[width:] - total[:-width] + width * middle


def hankel(conv: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` neighbouring values, as a view."""
    return np.lib.stride_tricks.sliding_window_view(conv, width)


def scatter(rows: np.ndarray, shift: float, block: int = 8192) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, column sums and cross products of rows - shift."""
    n, sums, cross = len(rows), np.zeros(rows.shape[1]), np.zeros((rows.shape[1], rows.shape[1]))
    for i in range(0, n, block):
        part = rows[i : i + block] - shift
        sums += part.sum(axis=0)
        cross += part.T @ part
    return n, sums, cross


def triangular(rows: np.ndarray, means: np.ndarray, block: int = 8192) -> np.ndarray:
    """R of the QR decomposition of rows - means, block by block."""
    r = np.zeros((0, rows.shape[1]))
    for i in range(0, len(rows), block):
        r = np.linalg.qr(np.vstack([r, rows[i : i + block] - means]), mode="r")
    return r


def components(square: np.ndarray, k: int = 3) -> np.ndarray:
    """The first k right singular vectors, given centred cross products or an R factor, each with a first coefficient of at least 0."""
    _, _, v = np.linalg.svd(square)
    pc = v[:k].T
    return pc * np.where(pc[0] < 0, -1.0, 1.0)


def rotation_to_z(ref: np.ndarray) -> np.ndarray:
    """Rotation that takes ref / |ref| to (0, 0, 1). Parallel vectors need none, opposite ones half a turn about x."""
    size = float(np.linalg.norm(ref))
    if size == 0 or not math.isfinite(size):
        raise ValueError("the reference vector has no direction")
    a = ref / size
    cross, dot = np.array([a[1], -a[0], 0.0]), float(a[2])
    sine = float(cross @ cross)
    if sine < 1e-30:
        return np.eye(3) if dot > 0 else np.diag([1.0, -1.0, -1.0])
    k = np.array([[0, 0, cross[1]], [0, 0, -cross[0]], [-cross[1], cross[0], 0]])
    return np.eye(3) + k + k @ k * ((1 - dot) / sine)


def crossings(x: np.ndarray, y: np.ndarray, segments: int, radius: float, directions: np.ndarray, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``transition`` (from 0), ``segment`` and ``distance`` of all crossings, in the order of transition and candidate. Candidates are some
    times as many as transitions and have many columns, so only those of ``block`` transitions are there at once."""
    if len(x) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    parts = [_crossings(x[i : i + block + 1], y[i : i + block + 1], segments, radius, directions) for i in range(0, len(x) - 1, block)]
    transition = np.concatenate([t + k * block for k, (t, _, _) in enumerate(parts)])
    return transition, np.concatenate([s for _, s, _ in parts]), np.concatenate([d for _, _, d in parts])


def _crossings(x: np.ndarray, y: np.ndarray, segments: int, radius: float, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    theta = np.arctan2(y, x)
    theta = np.where(np.isnan(theta), 0.0, np.where(theta < 0, theta + 2 * math.pi, theta))
    bucket = np.floor(theta / (2 * math.pi) * segments).astype(np.int64)
    direct = np.abs(bucket[1:] - bucket[:-1])
    diff = np.clip(np.minimum(direct, segments - direct), 0, segments // 2)
    n = 2 * (diff + 1)
    transition = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(transition)) - np.repeat(np.cumsum(n) - n, n)
    segment = (bucket[transition] - diff[transition] - 1 + place) % segments
    px, py = radius * directions[segment, 0], radius * directions[segment, 1]
    ax, ay, bx, by = x[transition], y[transition], x[transition + 1], y[transition + 1]
    div = (-px) * (ay - by) - (-py) * (ax - bx)
    det = ax * by - bx * ay
    with np.errstate(divide="ignore", invalid="ignore"):
        cx, cy = px * det / div, py * det / div
    inside = (
        (div != 0)
        & (cx >= np.minimum(0.0, px)) & (cx <= np.maximum(0.0, px)) & (cy >= np.minimum(0.0, py)) & (cy <= np.maximum(0.0, py))
        & (cx >= np.minimum(ax, bx)) & (cx <= np.maximum(ax, bx)) & (cy >= np.minimum(ay, by)) & (cy <= np.maximum(ay, by))
    )
    cx, cy = cx[inside], cy[inside]
    return transition[inside], segment[inside], np.sqrt(cx * cx + cy * cy)


#: exp(-a * a / 2) is exactly 0 in doubles where a is larger.
FAR = 38.7


def density_sums(distances: np.ndarray, points: np.ndarray, whitening: float, block: int = 256) -> np.ndarray:
    """Sum over samples of exp(-((sample - point) * whitening)**2 / 2) at each point (ascending). A block of neighbouring samples
    stays in the processor's cache and is set against the points where its terms aren't 0."""
    out, points, distances = np.zeros(len(points)), points * whitening, np.sort(distances) * whitening
    for i in range(0, len(distances), block):
        part = distances[i : i + block]
        a, b = np.searchsorted(points, (part[0] - FAR, part[-1] + FAR))
        away = part[:, None] - points[None, a:b]
        away *= away
        away *= -0.5
        out[a:b] += np.exp(away, out=away).sum(axis=0)
    return out


def maxima(density: np.ndarray) -> np.ndarray:
    """Places that are higher than both neighbours."""
    return np.flatnonzero((density[1:-1] > density[:-2]) & (density[1:-1] > density[2:])) + 1


def nearest(values: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Number of the nearest node (sorted radii) of each value; ties to the lower, 0 without nodes."""
    if not len(nodes):
        return np.zeros(len(values), np.int64)
    right = np.clip(np.searchsorted(nodes, values), 0, len(nodes) - 1)
    left = np.maximum(right - 1, 0)
    return np.where(np.abs(nodes[left] - values) <= np.abs(nodes[right] - values), left, right)


def edge_walk(transition: np.ndarray, node: np.ndarray, count: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transition, from, to) of the edge events of ``count`` transitions. ``node``: number of each crossing's node; ``last``: the node before, or -1."""
    has = np.bincount(transition, minlength=count) > 0 if len(transition) else np.zeros(count, bool)
    empty = np.flatnonzero(~has)
    at = np.concatenate([transition, empty])
    to = np.concatenate([node, np.full(len(empty), -1, np.int64)])
    order = np.argsort(at, kind="stable")
    at, to = at[order], to[order]
    place = np.maximum.accumulate(np.where(to >= 0, np.arange(len(to)), -1)) if len(to) else np.zeros(0, np.int64)
    reached = np.where(place >= 0, to[place], last)
    before = np.concatenate([[last], reached[:-1]]) if len(to) else reached
    good = before >= 0
    return at[good], before[good], np.where(to >= 0, to, reached)[good]


def slot_sums(transition: np.ndarray, summand: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of summands and number of events of each transition."""
    return np.bincount(transition, weights=summand, minlength=count), np.bincount(transition, minlength=count)


def moving(values: np.ndarray, length: int) -> np.ndarray:
    """Sums of complete frames."""
    if len(values) < length:
        return np.zeros(0)
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[length:] - total[:-length]


def frame_sums(values: np.ndarray, length: int, block: int = 1 << 20) -> np.ndarray:
    """``moving`` or ``sliding_sums`` with each frame added up for itself, the work growing with the length."""
    if len(values) < length:
        return np.zeros(0)
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(values, np.float64), length)
    step = max(1, block // length)
    return np.concatenate([frames[i : i + step].sum(axis=1) for i in range(0, len(frames), step)])
