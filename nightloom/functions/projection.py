"""Sky coordinates of image pixels as NumPy kernels: plate carree (CAR) and zenithal polynomial (ZPN), both ways, at any orientation.

Angles are degrees, pixels are 0-based with centres on integers (Calabretta & Greisen 2002).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np

from nightloom.functions.wcs import CarGrid, zpn_theta

#: How a projection is kept in a table.
WCS_SCHEMA = "struct<kind:string,crpix:array<double>,crval:array<double>,cdelt:array<double>,pc:array<double>,pv:array<double>,pole:array<double>>"


@dataclass(frozen=True)
class Projection:
    """kind: CAR or ZPN; crpix: 1-based reference pixel (x, y); crval: its sky position; cdelt: degrees per step of RA and Dec; pc: from pixels to these steps, row by row; pv: ZPN coefficients.

    pole: the native longitude of the sky's pole and the latitude that the native pole is to be near to; None where the projection's own are meant.
    """

    kind: str
    crpix: tuple[float, float]
    crval: tuple[float, float]
    cdelt: tuple[float, float]
    pc: tuple[float, float, float, float] = (1.0, 0.0, 0.0, 1.0)
    pv: tuple[float, ...] = ()
    pole: tuple[float | None, float] = (None, 90.0)

    def __post_init__(self):
        if self.kind not in ("CAR", "ZPN"):
            raise ValueError(f"projection {self.kind} is not supported")
        if self.kind == "ZPN" and len(self.pv) < 2:
            raise ValueError("a ZPN projection needs its coefficients")

    @classmethod
    def of_grid(cls, grid: CarGrid) -> Projection:
        return cls("CAR", grid.crpix, grid.crval, grid.cdelt)

    @classmethod
    def of_row(cls, row: Mapping) -> Projection:
        """From a struct of WCS_SCHEMA; a null pc is no rotation, a null or absent pole the projection's own."""
        made = cls(row["kind"], *(tuple(row[k]) for k in ("crpix", "crval", "cdelt")), tuple(row["pc"] or (1.0, 0.0, 0.0, 1.0)), tuple(row["pv"] or ()), tuple(row.get("pole") or (None, 90.0)))
        made._pole()
        return made

    @classmethod
    def of_row_or_none(cls, row: Mapping | None) -> Projection | None:
        """None where there is no projection, or one that can't be used."""
        try:
            return None if row is None else cls.of_row(row)
        except (ValueError, TypeError):
            return None

    @classmethod
    def of_header(cls, header: Mapping[str, str], key: str = "") -> Projection:
        """From FITS cards; key: the version of the coordinates. Axes may come in either order, rotation as PC or CD."""
        key = key.strip()
        number = lambda name, default: float(header.get(f"{name}{key}", default))
        lon = 2 if header.get(f"CTYPE1{key}", "").startswith("DEC") else 1
        axes = (lon, 3 - lon)
        kinds = {header[f"CTYPE{i}{key}"].split("-")[-1] for i in axes if f"CTYPE{i}{key}" in header}
        if len(kinds) != 1:
            raise ValueError(f"axes of different projections: {sorted(kinds)}")
        if any(f"CD{i}_{j}{key}" in header for i in axes for j in (1, 2)):
            pc, cdelt = tuple(number(f"CD{i}_{j}", 0) for i in axes for j in (1, 2)), (1.0, 1.0)
        else:
            pc, cdelt = tuple(number(f"PC{i}_{j}", i == j) for i in axes for j in (1, 2)), tuple(number(f"CDELT{i}", 1) for i in axes)
        pv = [number(f"PV{axes[1]}_{m}", 0) for m in range(30)]
        while pv and not pv[-1]:
            pv.pop()
        name = f"LONPOLE{key}"
        pole = (float(header[name]) if name in header else None, number("LATPOLE", 90))
        kind = kinds.pop()
        made = cls(kind, (number("CRPIX1", 0), number("CRPIX2", 0)), tuple(number(f"CRVAL{i}", 0) for i in axes), cdelt, pc, tuple(pv) if kind == "ZPN" else (), pole)
        made._pole()
        if abs(pc[0] * pc[3] - pc[1] * pc[2]) < 1e-300 or not all(cdelt):
            raise ValueError("the matrix of the axes can't be inverted")
        return made

    def _pole(self) -> tuple[float, float, float]:
        """Sky position of the native pole and the native longitude of the sky's pole (Calabretta & Greisen 2002, section 2.4)."""
        lon, lat = self.crval
        if self.kind == "ZPN":
            return lon, lat, (0.0 if lat >= 90 else 180.0) if self.pole[0] is None else self.pole[0]
        own = (0.0 if lat >= 0 else 180.0) if self.pole[0] is None else self.pole[0]
        return car_pole(lon, lat, own, self.pole[1])

    @property
    def upright(self) -> bool:
        return self.crval[1] == 0 and self.pole[0] in (None, 0.0)

    def pixel_to_world(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """RA in [0, 360) and Dec."""
        dx, dy = x + 1 - self.crpix[0], y + 1 - self.crpix[1]
        a = (self.pc[0] * dx + self.pc[1] * dy) * self.cdelt[0]
        b = (self.pc[2] * dx + self.pc[3] * dy) * self.cdelt[1]
        if self.kind == "CAR":
            phi, theta = a, b
            if self.upright:
                return (phi + self.crval[0]) % 360.0, theta
        else:
            phi, theta = np.rad2deg(np.arctan2(a, -b)), zpn_theta(np.hypot(a, b), self.pv)
        lon, lat, from_lon = self._pole()
        ra, dec = _turn(phi, theta, from_lon, lat, lon)
        return ra % 360.0, dec

    def world_to_pixel(self, ra: np.ndarray, dec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """NaN where a place has no pixel (behind a zenithal projection)."""
        if self.kind == "CAR" and self.upright:
            phi, theta = ra - self.crval[0], dec
        else:
            lon, lat, to_lon = self._pole()
            phi, theta = _turn(ra, dec, lon, lat, to_lon)
        phi = (phi + 180.0) % 360.0 - 180.0
        if self.kind == "CAR":
            a, b = phi, theta
        else:
            z = np.deg2rad(90.0 - theta)
            radius = np.where(z < np.pi / 2, np.rad2deg(np.polynomial.polynomial.polyval(z, self.pv)), np.nan)
            a, b = radius * np.sin(np.deg2rad(phi)), -radius * np.cos(np.deg2rad(phi))
        a, b = a / self.cdelt[0], b / self.cdelt[1]
        p, q, r, s = self.pc
        det = p * s - q * r
        return (s * a - q * b) / det + self.crpix[0] - 1, (p * b - r * a) / det + self.crpix[1] - 1


def car_pole(lon: float, lat: float, lon_pole: float, near: float = 90.0) -> tuple[float, float, float]:
    """Sky position of the native pole, and the native longitude of the sky's pole, of a cylindrical projection about (lon, lat).

    Of the two poles that the reference point and lon_pole allow the one nearer to the latitude near is meant, the northern one on a tie. ValueError where they allow none.
    """
    d, p = np.deg2rad(lat), np.deg2rad(lon_pole)
    if abs(np.cos(p)) < 1e-12 and abs(np.sin(d)) < 1e-12:  # the native pole lies on the equator's circle of latitudes: the latitude asked for
        up = near
    else:
        ratio = np.sin(d) / abs(np.cos(p)) if abs(np.cos(p)) > 1e-300 else np.inf
        if abs(ratio) > 1 + 1e-12:
            raise ValueError(f"no pole for a reference latitude of {lat} and a pole's longitude of {lon_pole}")
        base, away = (0.0 if np.cos(p) >= 0 else 180.0), np.rad2deg(np.arccos(np.clip(ratio, -1, 1)))
        turned = [(v + 180.0) % 360.0 - 180.0 for v in (base + away, base - away)]
        allowed = [v for v in turned if abs(v) <= 90 + 1e-9]
        if not allowed:
            raise ValueError(f"no pole for a reference latitude of {lat} and a pole's longitude of {lon_pole}")
        up = min(allowed, key=lambda v: (abs(v - near), -v))
    u = np.deg2rad(up)
    if abs(np.cos(d)) < 1e-12:
        return lon, up, lon_pole
    if abs(np.cos(u)) < 1e-12:
        return (lon + lon_pole - 180.0 if up > 0 else lon - lon_pole), up, lon_pole
    sin, cos = np.sin(p) / np.cos(d), -np.sin(u) * np.sin(d) / (np.cos(u) * np.cos(d))
    return lon - float(np.rad2deg(np.arctan2(sin, cos))), float(up), lon_pole


def _turn(lon: np.ndarray, lat: np.ndarray, from_pole: float, pole_lat: float, to_pole: float) -> tuple[np.ndarray, np.ndarray]:
    d, t, p = np.deg2rad(lon - from_pole), np.deg2rad(lat), np.deg2rad(pole_lat)
    lon2 = np.arctan2(-np.cos(t) * np.sin(d), np.sin(t) * np.cos(p) - np.cos(t) * np.sin(p) * np.cos(d))
    return np.rad2deg(lon2) + to_pole, np.rad2deg(np.arcsin(np.clip(np.sin(t) * np.sin(p) + np.cos(t) * np.cos(p) * np.cos(d), -1, 1)))


def edge(shape: tuple[int, int], trim: tuple[float, float, float, float] = (0, 0, 0, 0), per_side: int | None = 100) -> tuple[np.ndarray, np.ndarray]:
    """x and y of points along the outer edges of an image's pixels, less a trim (left, right, bottom, top); per_side None: about one for each pixel."""
    x0, x1, y0, y1 = trim[0] - 0.5, shape[1] - 0.5 - trim[1], trim[2] - 0.5, shape[0] - 0.5 - trim[3]
    xs = np.linspace(x0, x1, per_side or max(int(np.ceil(x1 - x0)) + 1, 2))
    ys = np.linspace(y0, y1, per_side or max(int(np.ceil(y1 - y0)) + 1, 2))
    return np.concatenate([xs, np.full(len(ys), x1), xs, np.full(len(ys), x0)]), np.concatenate([np.full(len(xs), y0), ys, np.full(len(xs), y1), ys])


def find_bounds(
    image: Projection, shape: tuple[int, int], grid: Projection, trim: tuple[float, float, float, float] = (0, 0, 0, 0),
    sky: tuple[float | None, float | None, float | None, float | None] | None = None, wrap_point: float = 0.0, wrap_aware: bool = False,
) -> list[tuple[int, int, int, int]]:
    """The pixel boxes (left, right, bottom, top) of a grid that hold an image's edges: one, none, or two where the image straddles the grid's ends.

    sky (RA from, to, Dec from, to; None: open): points outside of the Dec range say nothing about x, those outside of the RA range nothing
    about y; RA is taken in the turn that begins at wrap_point. wrap_aware: of 11 bins of x the first and last are filled and the middle one
    is empty: then the points on either side of the middle bin's start make up a box each. No box where a point of the edge has no place in the sky.
    """
    ra, dec = image.pixel_to_world(*edge(shape, trim))
    if np.isnan(ra).any() or np.isnan(dec).any():
        return []
    for_x = for_y = np.ones(len(ra), bool)
    if sky is not None:
        low_ra, high_ra, low_dec, high_dec = (default if v is None else v for v, default in zip(sky, (-np.inf, np.inf, -np.inf, np.inf), strict=True))
        turn = (ra - wrap_point) % 360.0 + wrap_point
        for_x, for_y = (low_dec <= dec) & (dec <= high_dec), (low_ra <= turn) & (turn <= high_ra)
    x, y = (v.round(9) for v in grid.world_to_pixel(ra, dec))
    if not for_x.any() or not for_y.any():
        return []
    sides = [np.ones(len(x), bool)]
    if wrap_aware:
        low, high = x[for_x].min(), x[for_x].max()
        bins = np.minimum(((x[for_x] - low) / max(high - low, 1e-12) * 11).astype(int), 10)
        if (bins == 0).any() and (bins == 10).any() and not (bins == 5).any():
            middle = low + (high - low) * 5 / 11
            sides = [x > middle, x < middle]
    boxes = []
    for side in sides:
        a, b = x[for_x & side], y[for_y & side]
        if len(a) and len(b):
            boxes.append((int(np.floor(a.min())), int(np.ceil(a.max())), int(np.floor(b.min())), int(np.ceil(b.max()))))
    return boxes


def with_poles(boxes: list[tuple[int, int, int, int]], image: Projection, shape: tuple[int, int], grid: Projection) -> list[tuple[int, int, int, int]]:
    """Boxes of an image's edges, made one that goes all the way around and up (or down) to a pole of the grid where the image holds that pole: edges don't enclose it."""
    if grid.kind != "CAR" or not boxes:
        return boxes
    half = 180.0 / abs(grid.cdelt[0])
    for side in (90.0, -90.0):
        y = side / grid.cdelt[1] + grid.crpix[1] - 1
        u, v = (float(c) for c in image.world_to_pixel(*grid.pixel_to_world(np.float64(grid.crpix[0] - 1), np.float64(y))))
        if -0.5 <= u <= shape[1] - 0.5 and -0.5 <= v <= shape[0] - 0.5:
            xs = [int(np.floor(grid.crpix[0] - 1 - half)), int(np.ceil(grid.crpix[0] - 1 + half))]
            ys = [e for b in boxes for e in b[2:]] + [int(np.floor(y)), int(np.ceil(y))]
            boxes = [(*xs, min(ys), max(ys))]
    return boxes
