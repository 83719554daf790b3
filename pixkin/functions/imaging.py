"""Pixel work on numpy arrays, for use inside Arrow and pandas functions: luma, resizing, the
perceptual hashes, band energies, cell hashes, corners, matching, homographies and warping."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: ITU-R 601 luma weights.
LUMA = (0.299, 0.587, 0.114)
#: Tables of weights that a worker keeps, each of as many sizes at most.
KEPT = 64


def luma(rgb: np.ndarray) -> np.ndarray:
    return np.asarray(rgb, float) @ np.array(LUMA)


@lru_cache(KEPT)
def _lanczos(n_in: int, n_out: int, lobes: int = 3) -> np.ndarray:
    """Rows of weights that turn n_in samples into n_out; the window widens when shrinking."""
    stretch = max(n_in / n_out, 1.0)
    centre = (np.arange(n_out) + 0.5) * n_in / n_out
    x = (np.arange(n_in)[None] + 0.5 - centre[:, None]) / stretch
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(1, keepdims=True)


@lru_cache(KEPT)
def _bands(n_in: int, n_out: int, step: int = 32) -> list[tuple[slice, slice, np.ndarray]]:
    """The weights of each few of the n_out samples, with those of the n_in that have any."""
    out = []
    for at in range(0, n_out, step):
        w = _lanczos(n_in, n_out)[at : at + step]
        some = np.flatnonzero(w.any(0))
        out.append((slice(at, at + len(w)), slice(some[0], some[-1] + 1), np.ascontiguousarray(w[:, some[0] : some[-1] + 1])))
    return out


def _rows(planes: np.ndarray, height: int) -> np.ndarray:
    out = np.empty((*planes.shape[:-2], height, planes.shape[-1]))
    for to, of, w in _bands(planes.shape[-2], height):
        np.matmul(w, planes[..., of, :], out=out[..., to, :])
    return out


def _columns(planes: np.ndarray, width: int) -> np.ndarray:
    flat = planes.reshape(-1, planes.shape[-1])
    out = np.empty((len(flat), width))
    for to, of, w in _bands(planes.shape[-1], width):
        np.matmul(flat[:, of], w.T, out=out[:, to])
    return out.reshape(*planes.shape[:-1], width)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lanczos, values kept within 0 to 255.  Colours are worked on plane by plane, and once where they're equal."""
    if image.shape[:2] == (height, width):
        return image.astype(float)
    planes = image if image.ndim == 2 else image.transpose(2, 0, 1)
    if image.ndim == 3 and (planes[1:] == planes[:1]).all():
        planes = planes[:1]
    out = _columns(_rows(planes.astype(float, order="C"), height), width)
    out.clip(0, 255, out=out)
    if image.ndim == 2:
        return out
    whole = np.empty((height, width, image.shape[2]))
    for c in range(image.shape[2]):
        whole[:, :, c] = out[min(c, len(out) - 1)]
    return whole


@lru_cache(KEPT)
def dct_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II."""
    k = np.arange(n)
    m = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def dct2(x: np.ndarray) -> np.ndarray:
    return dct_matrix(x.shape[-2]) @ x @ dct_matrix(x.shape[-1]).T


def phash(grey: np.ndarray, n: int) -> np.ndarray:
    """Low frequencies above their median."""
    low = dct2(resized(grey, 4 * n, 4 * n))[:n, :n]
    return (low > np.median(low)).ravel()


def dhash(grey: np.ndarray, n: int) -> np.ndarray:
    small = resized(grey, n + 1, n)
    return (small[:, 1:] > small[:, :-1]).ravel()


def ahash(grey: np.ndarray, n: int) -> np.ndarray:
    small = resized(grey, n, n)
    return (small > small.mean()).ravel()


def whash(grey: np.ndarray, n: int) -> np.ndarray:
    """Haar low band above its median, the image's overall mean taken out."""
    side = max(n, 1 << (min(grey.shape).bit_length() - 1))
    x = resized(grey, side, side) / 255
    x = x - x.mean()
    while x.shape[0] > n:  # a Haar step's low band is the sum of four over two
        x = (x[::2, ::2] + x[1::2, ::2] + x[::2, 1::2] + x[1::2, 1::2]) / 2
    return (x > np.median(x)).ravel()


def band_energies(grey: np.ndarray, side: int = 64) -> np.ndarray:
    """Shares of the low quarter, of what is neither, and of the high half of the spectrum."""
    power = dct2(resized(grey, side, side)) ** 2
    whole = power.sum() + 1e-9
    low, high = power[: side // 4, : side // 4].sum(), power[side // 2 :, side // 2 :].sum()
    return np.array([low, whole - low - high, high]) / whole


def cell_hashes(grey: np.ndarray, side: int, n: int) -> np.ndarray:
    """phash of each of side x side cells, all at once; pixels beyond whole cells are dropped."""
    h, w = grey.shape[0] // side, grey.shape[1] // side
    x = grey[: side * h, : side * w].astype(float)
    if (h, w) != (4 * n, 4 * n):
        x = _rows(x.reshape(side, h, side * w), 4 * n)
        x = _columns(x.reshape(side, 4 * n, side, w), 4 * n).clip(0, 255)
    x = x.reshape(side, 4 * n, side, 4 * n).transpose(0, 2, 1, 3)
    low = (dct_matrix(4 * n)[:n] @ x @ dct_matrix(4 * n)[:n].T).reshape(side * side, n * n)
    return (low > np.median(low, axis=1, keepdims=True)).ravel()


#: Rows of an image of which corners are sought at a time, so that what is worked on stays near the processor.
STRIP = 32


def _mean(x: np.ndarray, r: int) -> np.ndarray:
    """Of each 2 r + 1 neighbours in the last axis."""
    n = x.shape[-1] - 2 * r
    out = x[..., 2 * r :] + x[..., 2 * r - 1 : -1]
    for k in range(2 * r - 2, -1, -1):
        out += x[..., k : k + n]
    out /= 2 * r + 1
    return out


def corners(grey: np.ndarray, most: int = 5000) -> np.ndarray:
    """(x, y) of the strongest corners by the smaller eigenvalue of the local structure."""
    edge, r = 16, 2
    high, wide = (max(n - 2 * edge, 0) for n in grey.shape)
    strength = np.zeros((high + 2, wide + 2))  # with a rim, and nothing near the image's edges
    for at in range(0, high if wide else 0, STRIP):
        n = min(STRIP, high - at)
        own = grey[edge + at - r - 1 : edge + at + n + r + 1, edge - r - 1 : grey.shape[1] - edge + r + 1].astype(float)
        gy, gx = (own[2:, 1:-1] - own[:-2, 1:-1]) / 2, (own[1:-1, 2:] - own[1:-1, :-2]) / 2
        part = np.empty((3, *gx.shape))
        for k, (p, q) in enumerate(((gx, gx), (gx, gy), (gy, gy))):
            np.multiply(p, q, out=part[k])
        part = _mean(part.transpose(0, 2, 1), r).transpose(0, 2, 1)
        a, b, c = _mean(part, r)
        apart = a - c
        apart /= 2
        apart *= apart
        b *= b
        apart += b
        a += c
        a /= 2
        np.subtract(a, np.sqrt(apart, out=apart), out=strength[1 + at : 1 + at + n, 1:-1])
    inner, best = strength[1:-1, 1:-1], np.maximum(np.maximum(strength[:-2], strength[1:-1]), strength[2:])
    best = np.maximum(np.maximum(best[:, :-2], best[:, 1:-1]), best[:, 2:])
    y, x = divmod(np.flatnonzero((inner >= best) & (inner > max(strength.max() * 0.01, 1e-6))), max(wide, 1))
    order = np.argsort(-inner[y, x], kind="stable")[:most]
    return np.stack([x[order] + edge, y[order] + edge], 1).astype(float)


@lru_cache(1)
def _offsets() -> np.ndarray:
    return np.random.default_rng(256).normal(0, 5, (256, 4)).clip(-14, 14).round().astype(int)


def descriptors(grey: np.ndarray, points: np.ndarray) -> np.ndarray:
    """256 comparisons of smoothed pixels around each point, at places fixed by a seed."""
    offset = _offsets()
    x, y = points[:, 0].astype(int)[:, None], points[:, 1].astype(int)[:, None]
    smooth = sum(np.roll(grey, (i, j), (0, 1)) for i in (-1, 0, 1) for j in (-1, 0, 1))
    return smooth[y + offset[:, 1], x + offset[:, 0]] < smooth[y + offset[:, 3], x + offset[:, 2]]


def ratio_matches(a: np.ndarray, b: np.ndarray, ratio: float = 0.75) -> np.ndarray:
    """(row of a, row of b): for each of b its nearest of a, if clearly nearer than the second."""
    if len(a) < 2 or not len(b):
        return np.zeros((0, 2), int)
    # of vectors of 1 and -1, the inner product is the bits less twice those that differ
    x, y = (2 * v.astype(np.float32) - 1 for v in (a, b))
    apart = np.rint((a.shape[1] - y @ x.T) / 2).astype(np.int64)
    near = np.argsort(apart, axis=1, kind="stable")[:, :2]
    d = np.take_along_axis(apart, near, 1)
    good = np.flatnonzero(d[:, 0] < ratio * d[:, 1])
    return np.stack([near[good, 0], good], 1)


def _homographies(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """`homography` of each of many sets of as many points; not finite where there is none."""

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = p - (m := p.mean(1, keepdims=True))
        s = np.sqrt(2) / np.maximum(np.sqrt((p**2).sum(2)).mean(1), 1e-12)
        t = np.zeros((len(p), 3, 3))
        t[:, 0, 0] = t[:, 1, 1] = s
        t[:, :2, 2], t[:, 2, 2] = -s[:, None] * m[:, 0], 1
        return p * s[:, None, None], t

    (p, tp), (q, tq) = normal(src), normal(dst)
    rows = np.zeros((len(p), 2, p.shape[1], 9))
    rows[:, 0, :, :2] = rows[:, 1, :, 3:5] = p
    rows[:, 0, :, 2] = rows[:, 1, :, 5] = 1
    rows[:, :, :, 6:8] = -q.transpose(0, 2, 1)[..., None] * p[:, None]
    rows[:, :, :, 8] = -q.transpose(0, 2, 1)
    rows = rows.reshape(len(p), -1, 9)
    h = np.linalg.svd(rows, full_matrices=rows.shape[1] < 9)[2][:, -1].reshape(-1, 3, 3)
    h = np.linalg.inv(tq) @ h @ tp
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.abs(h[:, 2:, 2:]) > 1e-12, h / h[:, 2:, 2:], np.nan)


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Least-squares map of four points or more (direct linear transform, normalised)."""
    h = _homographies(src[None], dst[None])[0]
    return h if np.isfinite(h).all() else None


def _of_fours(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The maps of many fours of points: as products where no three of them lie on a line, else as `homography` has it."""

    def spanned(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The map of the unit vectors and their sum onto four points, and by how much these miss a line."""
        p = np.concatenate([p, np.ones((*p.shape[:2], 1))], 2).transpose(0, 2, 1)
        one = lambda i, j, k: ((p[:, 0, j] - p[:, 0, i]) * (p[:, 1, k] - p[:, 1, i]) - (p[:, 1, j] - p[:, 1, i]) * (p[:, 0, k] - p[:, 0, i]))
        each = np.stack([one(3, 1, 2), one(0, 3, 2), one(0, 1, 3)], 1)
        return p[:, :, :3] * each[:, None], np.minimum(np.abs(each).min(1), np.abs(one(0, 1, 2)))

    (p, apart), (q, other) = spanned(src), spanned(dst)
    good = (apart > 0.5) & (other > 0.5)
    h = np.full((len(p), 3, 3), np.nan)
    x, y, z = p[good].transpose(2, 0, 1)
    h[good] = q[good] @ np.stack([np.cross(y, z), np.cross(z, x), np.cross(x, y)], 1)
    h /= np.abs(h).max((1, 2), keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.where(np.abs(h[:, 2:, 2:]) > 1e-12, h / h[:, 2:, 2:], np.nan)
    if not good.all():
        h[~good] = _homographies(src[~good], dst[~good])
    return h


def mapped(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    x = np.concatenate([points, np.ones((len(points), 1))], 1) @ h.T
    return x[:, :2] / np.where(np.abs(x[:, 2:]) < 1e-12, 1e-12, x[:, 2:])


@lru_cache(KEPT)
def _picks(n: int, rounds: int, seed: int) -> np.ndarray:
    """Four of n, again and again."""
    draw = np.random.default_rng(seed)
    return np.stack([draw.choice(n, 4, replace=False) for _ in range(rounds)])


def ransac(src: np.ndarray, dst: np.ndarray, pixels: float = 4.0, rounds: int = 500, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """The map most points agree with to within `pixels`, and which do."""
    best = np.zeros(len(src), bool)
    if len(src) < 4:
        return None, best
    x = np.concatenate([src, np.ones((len(src), 1))], 1).T
    picks = _picks(len(src), rounds, seed)
    for at in range(0, rounds, 100):
        pick = picks[at : at + 100]
        h = _of_fours(src[pick], dst[pick])
        h = h[np.isfinite(h).all((1, 2))]
        if not len(h):
            continue
        seen = h @ x
        w = seen[:, 2]
        w[np.abs(w) < 1e-12] = 1e-12
        good = np.hypot(seen[:, 0] / w - dst[:, 0], seen[:, 1] / w - dst[:, 1]) <= pixels
        many = good.sum(1)
        if many.max() > best.sum():
            best = good[many.argmax()]
        if best.all():  # none has more
            break
    return (homography(src[best], dst[best]), best) if best.sum() >= 4 else (None, best & False)


def warped(image: np.ndarray, h: np.ndarray, width: int, height: int) -> np.ndarray:
    """image seen through h, bilinear, edges repeated."""
    y, x = np.mgrid[:height, :width]
    at = mapped(np.linalg.inv(h), np.stack([x.ravel(), y.ravel()], 1).astype(float))
    px, py = at[:, 0].clip(0, image.shape[1] - 1), at[:, 1].clip(0, image.shape[0] - 1)
    x0, y0 = np.minimum(px.astype(int), image.shape[1] - 2), np.minimum(py.astype(int), image.shape[0] - 2)
    fx, fy = px - x0, py - y0
    if image.ndim == 3:
        fx, fy = fx[:, None], fy[:, None]
    out = (image[y0, x0] * (1 - fx) + image[y0, x0 + 1] * fx) * (1 - fy) + (image[y0 + 1, x0] * (1 - fx) + image[y0 + 1, x0 + 1] * fx) * fy
    return out.reshape(height, width, *image.shape[2:])
