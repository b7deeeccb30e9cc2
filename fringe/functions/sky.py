"""Angular separation and the nine map projections, as column expressions.

Angles are degrees. Outside a projection's domain both results are null.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import null_if_nan

PROJECTIONS = ("CAR", "SIN", "TAN", "ARC", "NCP", "GLS", "MER", "AIT", "STG")


def angular_separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """By haversine, its argument held to [0, 1]."""
    sd, sr = F.sin(F.radians(dec2 - dec1) / 2), F.sin(F.radians(ra2 - ra1) / 2)
    a = sd * sd + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * sr * sr
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))
    return F.degrees(2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)))


#: Projections about a point, whose maps turn with the native longitude of the celestial pole.
ABOUT_A_POINT = ("SIN", "TAN", "ARC", "STG")


@dataclass(frozen=True)
class Projection:
    """Reference sky position and pixel, pixel size, rotation (all degrees) and kind.

    ``matrix`` (degrees a pixel, row by row) stands for sizes and rotation where it is given, and may be skewed.
    ``pole`` is the native longitude of the celestial pole; other than 180 only for projections about a point.
    """

    ra: float
    dec: float
    x_pixel: float = 0.0
    y_pixel: float = 0.0
    x_step: float = 1.0
    y_step: float = 1.0
    rotation: float = 0.0
    kind: str = "TAN"
    matrix: tuple[float, float, float, float] | None = None
    pole: float = 180.0

    def __post_init__(self) -> None:
        if self.pole % 360 != 180 and self.kind not in ABOUT_A_POINT:
            raise ValueError(f"{self.kind} with the pole at {self.pole}")
        a, b, c, d = self._linear()
        if not a * d - b * c:
            raise ValueError("pixels have no area")
        if self.kind not in PROJECTIONS:
            raise ValueError(f"unknown projection {self.kind}; known: {', '.join(PROJECTIONS)}")

    def _linear(self) -> tuple[float, float, float, float]:
        """The matrix from pixels to degrees in the plane of the map, row by row."""
        c, s = math.cos(math.radians(self.rotation)), math.sin(math.radians(self.rotation))
        a, b, d, e = self.matrix or (self.x_step * c, -self.y_step * s, self.x_step * s, self.y_step * c)
        turn = math.radians(180.0 - self.pole)
        c, s = (1.0, 0.0) if self.pole % 360 == 180 else (math.cos(turn), math.sin(turn))
        return a * c - d * s, b * c - e * s, d * c + a * s, e * c + b * s

    @classmethod
    def from_header(cls, header: Mapping[str, object], first: int = 1, second: int = 2) -> Projection:
        """From image keywords (CRVAL, CRPIX, CDELT with CROTA or a PC matrix, or a CD matrix, CTYPE, LONPOLE) of two axes; without CTYPE it is CAR.

        A declination axis that comes first is taken as the second.
        """
        if str(header.get(f"CTYPE{first}", "")).strip().upper()[:4] in ("DEC-", "GLAT", "ELAT"):
            first, second = second, first
        names = {"value": "CRVAL{}", "pixel": "CRPIX{}", "step": "CDELT{}", "turn": "CROTA{}", "type": "CTYPE{}", "cd": "CD{}_{}", "pc": "PC{}_{}"}
        return cls._from_keys(header, names, first, second)

    @classmethod
    def from_table_header(cls, header: Mapping[str, object], x: str, y: str) -> Projection:
        """From the keywords of two columns of a table, by their names (TCRVLn, TCRPXn, TCDLTn with TCROTn or a TPn_m matrix, or a TCn_m matrix, TCTYPn)."""
        columns = {str(v).strip().upper(): int(k[5:]) for k, v in header.items() if k.startswith("TTYPE") and k[5:].isdigit()}
        names = {"value": "TCRVL{}", "pixel": "TCRPX{}", "step": "TCDLT{}", "turn": "TCROT{}", "type": "TCTYP{}", "cd": "TC{}_{}", "pc": "TP{}_{}"}
        if lacking := [c for c in (x, y) if c.upper() not in columns]:
            raise ValueError(f"no columns {lacking}")
        return cls._from_keys(header, names, columns[x.upper()], columns[y.upper()])

    @classmethod
    def _from_keys(cls, header: Mapping[str, object], names: Mapping[str, str], first: int, second: int) -> Projection:
        def number(name: str, *axes: int, default: float = 0.0) -> float:
            return float(header.get(names[name].format(*axes), default))

        axes = (first, second)
        steps = [number("step", i, default=1.0) for i in axes]
        places = [(i, j) for i in axes for j in axes]
        matrix, rotation = None, number("turn", second)
        if any(names["cd"].format(*p) in header for p in places):
            a, b, c, d = matrix = tuple(number("cd", *p) for p in places)
            sign = 1.0 if a * d - b * c >= 0 else -1.0  # sizes and rotation of a matrix that isn't skewed
            steps = [sign * math.hypot(a, c), math.hypot(b, d)]
            rotation = math.degrees(math.atan2(sign * c, sign * a))
        elif any(names["pc"].format(*p) in header for p in places):
            matrix = tuple(steps[axes.index(i)] * number("pc", i, j, default=float(i == j)) for i, j in places)
        kind = str(header.get(names["type"].format(first), "")).strip()[-4:]
        return cls(
            number("value", first), number("value", second), number("pixel", first), number("pixel", second), *steps, rotation, kind[1:] if kind.startswith("-") else "CAR",
            matrix, float(header.get("LONPOLE", 180.0)),
        )

    def to_sky(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Right ascension in [0, 360) and declination of a pixel."""
        a, b, c, d = self._linear()
        dx, dy = x - self.x_pixel, y - self.y_pixel
        el, em = F.radians(dx * a + dy * b), F.radians(dx * c + dy * d)
        r2 = el * el + em * em
        ra0, d0 = math.radians(self.ra), math.radians(self.dec)
        s0, c0 = math.sin(d0), math.cos(d0)
        inside = F.lit(True)
        match self.kind:
            case "CAR":
                ra, dec = ra0 + el, d0 + em
            case "SIN":
                inside = r2 <= 1
                ct = F.sqrt(1 - r2)
                ra, dec = ra0 + F.atan2(el, c0 * ct - em * s0), F.asin(em * c0 + s0 * ct)
            case "TAN":
                ra = ra0 + F.atan2(el, c0 - em * s0)
                # By its direction, which holds on either side of the pole.
                dec = F.atan2(s0 + em * c0, F.sqrt((c0 - em * s0) * (c0 - em * s0) + el * el))
            case "ARC":
                r = F.sqrt(r2)
                inside = r < math.pi
                q = F.when(r > 0, F.sin(r) / r).otherwise(1.0)
                dec = F.asin(em * c0 * q + s0 * F.cos(r))
                ra = ra0 + F.atan2(el * q, (F.cos(r) - s0 * F.sin(dec)) / c0) if c0 else ra0 + F.atan2(el * q, -em * q * s0)
            case "NCP":
                t = c0 - em * s0
                ra = ra0 + F.atan2(el, t)
                cos_dec = F.sqrt(t * t + el * el)
                inside = cos_dec <= 1
                dec = F.acos(cos_dec) * (1 if self.dec >= 0 else -1)
            case "GLS":
                dec = d0 + em
                inside = (F.abs(dec) <= math.pi / 2) & (F.abs(el) <= math.pi * F.cos(dec))
                ra = ra0 + F.when(F.abs(F.cos(dec)) > 1e-12, el / F.cos(dec)).otherwise(0.0)
            case "MER":
                ra = ra0 + el
                dec = 2 * F.atan(F.exp(em + math.log(math.tan(d0 / 2 + math.pi / 4)))) - math.pi / 2
            case "AIT":  # the projection's own origin lies on the equator
                em = em + s0 / math.sqrt((1 + c0) / 2)
                z = 1 - el * el / 16 - em * em / 4
                inside = z >= 0.5
                w = F.sqrt(z)
                ra, dec = ra0 + 2 * F.atan2(w * el / 2, 2 * z - 1), F.asin(em * w)
            case "STG":
                ct = (4 - r2) / (4 + r2)
                q = (1 + ct) / 2
                dec = F.asin(ct * s0 + em * q * c0)
                ra = ra0 + F.atan2(el * q, ct * c0 - em * q * s0)
        sky_ra = F.pmod(F.degrees(ra), F.lit(360.0))
        good = inside & ~F.isnan(ra) & ~F.isnan(dec)
        return F.when(good, sky_ra), F.when(good, F.degrees(dec))

    def to_pixel(self, ra: Column, dec: Column) -> tuple[Column, Column]:
        """The pixel of a sky position; null for points that the projection can't show."""
        d0 = math.radians(self.dec)
        s0, c0 = math.sin(d0), math.cos(d0)
        # The difference in right ascension, within half a turn.
        da = F.radians(F.pmod(ra - self.ra + 180.0, F.lit(360.0)) - 180.0)
        d = F.radians(dec)
        sd, cd = F.sin(d), F.cos(d)
        across, along = cd * F.sin(da), sd * c0 - cd * s0 * F.cos(da)
        ct = sd * s0 + cd * c0 * F.cos(da)
        inside = F.abs(dec) <= 90
        match self.kind:
            case "CAR":
                el, em = da, d - d0
            case "SIN":
                inside, el, em = inside & (ct >= 0), across, along
            case "TAN":
                inside, el, em = inside & (ct > 0), F.try_divide(across, ct), F.try_divide(along, ct)
            case "ARC":
                t = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ct)))
                q = F.when(F.sin(t) > 1e-12, F.try_divide(t, F.sin(t))).otherwise(1.0)
                el, em = across * q, along * q
            case "NCP":
                inside = inside & (s0 != 0)
                el, em = across, (c0 - cd * F.cos(da)) / s0 if s0 else F.lit(None).cast("double")
            case "GLS":
                el, em = da * cd, d - d0
            case "MER":
                inside = F.abs(dec) < 90
                el, em = da, F.ln(F.tan(d / 2 + math.pi / 4)) - math.log(math.tan(d0 / 2 + math.pi / 4))
            case "AIT":
                w = F.sqrt((1 + cd * F.cos(da / 2)) / 2)
                el, em = 2 * cd * F.sin(da / 2) / w, sd / w - s0 / math.sqrt((1 + c0) / 2)
            case "STG":
                inside, el, em = inside & (ct > -1), F.try_divide(2 * across, 1 + ct), F.try_divide(2 * along, 1 + ct)
        a, b, c, d = self._linear()
        area = a * d - b * c
        dx, dy = F.degrees(el), F.degrees(em)
        x, y = dx * (d / area) - dy * (b / area) + self.x_pixel, dy * (a / area) - dx * (c / area) + self.y_pixel
        good = inside & el.isNotNull() & em.isNotNull()
        return F.when(good, null_if_nan(x)), F.when(good, null_if_nan(y))
