"""Adaptive resampling of an image onto another grid (DeForest 2004).

Around each output pixel the map to input pixels is linear; its singular values are padded to at least one, so the
footprint covers an input pixel, and the input under it is averaged with Gaussian weights in the padded frame. What a pixel gets
depends on its own footprint alone, never on what else is resampled with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

KERNEL_WIDTH = 1.3
#: Squared radius of a footprint in the padded frame.
RADIUS2 = 8 + 1e-9
#: A Jacobian is a spike where the sum of its squares is so many times the third least of its neighbourhood.
SPIKE = 10.0
#: Weights that are computed at once.
CHUNK = 2**19

#: Output x and y to input x and y, arrays to arrays.
Mapping = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def jacobian(mapping: Mapping, x: np.ndarray, y: np.ndarray, period: float | None = None) -> np.ndarray:
    """d(input) / d(output) by centred differences; steps over a cyclic edge are taken the short way."""
    out = np.empty((*x.shape, 2, 2))
    for k, (dx, dy) in enumerate(((0.5, 0.0), (0.0, 0.5))):
        (u1, v1), (u0, v0) = mapping(x + dx, y + dy), mapping(x - dx, y - dy)
        du = u1 - u0
        if period is not None:
            du = (du + period / 2) % period - period / 2
        out[..., 0, k], out[..., 1, k] = du, v1 - v0
    return out


def despiked(j: np.ndarray) -> np.ndarray:
    """Jacobians of a grid, less its outermost pixels: where the input's coordinates jump (at a seam or a pole) the mean of the neighbours that don't."""
    size = np.where(np.isfinite(j).all((-1, -2)), (j**2).sum((-1, -2)), np.inf)
    ny, nx = size.shape
    around = np.stack([size[a : ny - 2 + a, b : nx - 2 + b] for a in range(3) for b in range(3)])
    third = np.sort(around, 0)[2]
    with np.errstate(invalid="ignore"):
        plain = (around <= SPIKE * third) & np.isfinite(around)
    inner = j[1:-1, 1:-1]
    near = np.stack([j[a : ny - 2 + a, b : nx - 2 + b] for a in range(3) for b in range(3)])
    many = plain.sum(0)
    mean = np.where(plain[..., None, None], near, 0).sum(0) / np.maximum(many, 1)[..., None, None]
    return np.where((plain[4] | (many == 0))[..., None, None], inner, mean)


def footprints(j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The quadratic form (a, b, c) whose value a du^2 + 2 b du dv + c dv^2 is the squared distance in the padded frame, and how far the footprint reaches in u and v.

    Singular values and the left rotation of a 2 x 2 matrix in closed form.
    """
    e, f = (j[..., 0, 0] + j[..., 1, 1]) / 2, (j[..., 0, 0] - j[..., 1, 1]) / 2
    g, h = (j[..., 1, 0] + j[..., 0, 1]) / 2, (j[..., 1, 0] - j[..., 0, 1]) / 2
    q, r = np.hypot(e, h), np.hypot(f, g)
    large, small = np.maximum(q + r, 1), np.maximum(np.abs(q - r), 1)
    turn = (np.arctan2(h, e) + np.arctan2(g, f)) / 2
    c, s = np.cos(turn), np.sin(turn)
    p, m = large**-2, small**-2
    reach_u, reach_v = np.sqrt(RADIUS2 * ((c * large) ** 2 + (s * small) ** 2)), np.sqrt(RADIUS2 * ((s * large) ** 2 + (c * small) ** 2))
    return c * c * p + s * s * m, c * s * (p - m), s * s * p + c * c * m, reach_u, reach_v


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(keys) else np.zeros(0, int)
    for part in np.split(order, first[1:]) if len(keys) else ():
        yield int(keys[part[0]]), part


def resample(image: np.ndarray, mapping: Mapping, shape: tuple[int, int], strict: bool = True, conserve_flux: bool = True, cyclic: bool = False, despike: bool = True) -> np.ndarray:
    """The image (rows and columns last; planes ahead of them share the mapping) on a grid of the shape; NaN where nothing is.

    strict: NaN also where any part of the footprint is outside; else what is inside is averaged. A missing input pixel under the footprint
    gives NaN. conserve_flux: values are multiplied by the area of a pixel in input pixels. cyclic: x wraps around, and a footprint as wide as
    the image takes each column once. despike: Jacobians over a jump of the coordinates are replaced by their neighbours'.

    Pixels of one reach are done together, each over its own window and no more of it than the image has; the time is that of the windows' areas.
    """
    planes = image.reshape(-1, *image.shape[-2:])
    ny, nx = planes.shape[1:]
    y, x = (g - 1.0 for g in np.mgrid[: shape[0] + 2, : shape[1] + 2])  # with the neighbours of the outermost pixels
    j = jacobian(mapping, x, y, nx if cyclic else None)
    j = (despiked(j) if despike else j[1:-1, 1:-1]).reshape(-1, 2, 2)
    u, v = (np.asarray(c, float).ravel() for c in mapping(x[1:-1, 1:-1], y[1:-1, 1:-1]))
    good = np.flatnonzero(np.isfinite(u) & np.isfinite(v) & np.isfinite(j).all((-1, -2)))
    out = np.full((len(planes), len(u)), np.nan)
    u, v, j = u[good], v[good], j[good]
    a, b, c, reach_u, reach_v = footprints(j)
    cu, cv = np.rint(u).astype(np.int64), np.rint(v).astype(np.int64)
    ru, rv = (np.floor(r + np.abs(w - near)).astype(np.int64) for r, w, near in ((reach_u, u, cu), (reach_v, v, cv)))
    touches = (cv + rv >= 0) & (cv - rv < ny)
    if cyclic:
        ru = np.minimum(ru, nx // 2)
    else:
        touches &= (cu + ru >= 0) & (cu - ru < nx)
    if strict:  # a footprint is a convex body about its centre: what is wider than the image leaves it
        touches &= (rv <= ny) & (cv >= 0) & (cv < ny)
        if not cyclic:
            touches &= (ru <= nx) & (cu >= 0) & (cu < nx)
    live = np.flatnonzero(touches)
    for key, part in _groups(ru[live] * 2**31 + rv[live]):
        wide, high = divmod(key, 2**31)
        rows = live[part]
        # Offsets about the pixel, or the image's own rows and columns where these are fewer.
        all_v, all_u = not strict and 2 * high + 1 > ny, not strict and not cyclic and 2 * wide + 1 > nx
        vs, us = np.arange(ny) if all_v else np.arange(-high, high + 1), np.arange(nx) if all_u else np.arange(-wide, wide + 1)
        if cyclic and 2 * wide + 1 > nx:
            us = us[:nx]
        step_v = max(1, CHUNK // len(us))
        step = max(1, CHUNK // (len(us) * min(len(vs), step_v)))
        for at in range(0, len(rows), step):
            k = rows[at : at + step]
            total, weights, outside = np.zeros((len(planes), len(k))), np.zeros(len(k)), np.zeros(len(k), bool)
            pu = us[None, :] + (0 if all_u else cu[k, None])
            du = pu - u[k, None]
            in_u = np.ones(pu.shape, bool) if cyclic else (pu >= 0) & (pu < nx)
            pu = pu % nx if cyclic else np.clip(pu, 0, nx - 1)
            for begin in range(0, len(vs), step_v):
                pv = vs[None, begin : begin + step_v] + (0 if all_v else cv[k, None])
                dv = pv - v[k, None]
                in_v = (pv >= 0) & (pv < ny)
                pv = np.clip(pv, 0, ny - 1)
                r2 = a[k, None, None] * (du**2)[:, None, :] + (2 * b[k, None] * dv)[:, :, None] * du[:, None, :] + (c[k, None] * dv**2)[:, :, None]
                w = np.where(r2 <= RADIUS2, np.exp(-2 * r2 / KERNEL_WIDTH**2), 0)
                inside = in_v[:, :, None] & in_u[:, None, :]
                outside |= ((w > 0) & ~inside).any((1, 2))
                w = np.where(inside, w, 0)
                for plane, values in enumerate(planes):
                    total[plane] += np.where(w > 0, w * values[pv[:, :, None], pu[:, None, :]], 0).sum((1, 2))
                weights += w.sum((1, 2))
            with np.errstate(invalid="ignore", divide="ignore"):
                value = total / weights
            out[:, good[k]] = np.where((weights > 0) & ~(strict & outside), value, np.nan)
    if conserve_flux:
        out[:, good] *= np.abs(j[:, 0, 0] * j[:, 1, 1] - j[:, 0, 1] * j[:, 1, 0])
    return out.reshape(*image.shape[:-2], *shape)


def affine(turn: float, scale: float, centre_in: tuple[float, float], centre_out: tuple[float, float]) -> Mapping:
    """Input pixels of output pixels that are turned by degrees and scaled about two centres (x, y)."""
    c, s = np.cos(np.deg2rad(turn)) * scale, np.sin(np.deg2rad(turn)) * scale
    return lambda x, y: (
        c * (x - centre_out[0]) - s * (y - centre_out[1]) + centre_in[0],
        s * (x - centre_out[0]) + c * (y - centre_out[1]) + centre_in[1],
    )


def convolved(image: np.ndarray, taps: list[tuple[int, int, float]]) -> np.ndarray:
    """Each pixel spread over (dy, dx, weight), zero outside of the image; a missing pixel spreads over all of them."""
    reach = max(max(abs(dy), abs(dx)) for dy, dx, _ in taps)
    p = np.pad(image, reach)
    ny, nx = image.shape
    out = np.zeros(image.shape)
    for dy, dx, w in taps:
        out += w * p[reach - dy : reach - dy + ny, reach - dx : reach - dx + nx]
    return out


def gaussian_taps(width: float, shift_y: float = 0.0, shift_x: float = 0.0, reach: int = 2) -> list[tuple[int, int, float]]:
    """Weights exp(-2 r^2 / width^2) about a shifted centre, of sum 1."""
    raw = [(dy, dx, np.exp(-2 * ((dx - shift_x) ** 2 + (dy - shift_y) ** 2) / width**2)) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
    total = sum(w for _, _, w in raw)
    return [(dy, dx, float(w / total)) for dy, dx, w in raw]


def blurred(image: np.ndarray) -> np.ndarray:
    """The image blurred as two rounds of resampling do."""
    return convolved(image, gaussian_taps(KERNEL_WIDTH * 2**0.5))


def closed(mask: np.ndarray, rounds: int) -> np.ndarray:
    """Binary closing by a cross, so many dilations and then erosions; beyond the edge nothing is set for the one and everything for the other."""

    def grow(a: np.ndarray) -> np.ndarray:
        p = np.pad(a, 1)
        return p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]

    wide = np.pad(mask, rounds)
    for _ in range(rounds):
        wide = grow(wide)
    for _ in range(rounds):
        wide = ~grow(~wide)
    return wide[rounds:-rounds, rounds:-rounds] if rounds else wide
