"""Datum shift of planar coordinates as pure column arithmetic.

Krueger's series in the third flattening n, to its fourth power, in both directions of
the transverse Mercator projection (better than a millimetre over a whole zone), a
seven-parameter shift of geocentric coordinates and Bowring's closed latitude between.
Every step is a list of named formulas over columns, so the same formulas can be
written as SQL.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: ellipsoids (semi-major axis, inverse flattening)
HAYFORD = (6378388.0, 297.0)
GRS80 = (6378137.0, 298.257222101)
# fixed values: published transformation between the two datums
SHIFT_M = (-131.0, -100.3, -163.4)
ROTATION_ARCSEC = (-1.244, -0.02, -1.144)
SCALE_PPM = 9.39
# fixed values: projection zone
K0 = 0.9996
LON0 = math.radians(-3.0)
FALSE_EAST = 500000.0
# fixed values: published coefficients of n, n^2, n^3, n^4 for sines of 2, 4, 6 and 8 times the angle
FORWARD = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
INVERSE = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
LATITUDE = ((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))


@dataclass(frozen=True)
class Spheroid:
    a: float
    f: float

    @classmethod
    def of(cls, pair: tuple[float, float]) -> Spheroid:
        return cls(pair[0], 1 / pair[1])

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def n(self) -> float:
        return self.f / (2 - self.f)

    @property
    def radius(self) -> float:
        """Radius whose circle is as long as the meridian."""
        n = self.n
        return self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def series(self, table: tuple) -> list[float]:
        return [sum(c * self.n**k for k, c in enumerate(row, 1)) for row in table]


def _sum(coefficients: list[float], term: str) -> str:
    return " + ".join(f"({c!r}) * {term.format(k=2 * j)}" for j, c in enumerate(coefficients, 1))


def shift_steps(x: str, y: str) -> list[dict[str, str]]:
    """Formulas from old to new planar coordinates; each step uses names of those before it."""
    old, new = Spheroid.of(HAYFORD), Spheroid.of(GRS80)
    rx, ry, rz = (r * math.pi / 648000 for r in ROTATION_ARCSEC)
    m = 1 + SCALE_PPM * 1e-6
    inv, lat, fwd = old.series(INVERSE), old.series(LATITUDE), new.series(FORWARD)
    b, root = new.a * (1 - new.f), math.sqrt(new.e2)
    scale = K0 * new.radius
    return [
        {"xi": f"({y}) / {K0 * old.radius!r}", "eta": f"(({x}) - {FALSE_EAST!r}) / {K0 * old.radius!r}"},
        {"xi1": f"xi - ({_sum(inv, 'sin({k} * xi) * cosh({k} * eta)')})", "eta1": f"eta - ({_sum(inv, 'cos({k} * xi) * sinh({k} * eta)')})"},
        {"chi": "asin(sin(xi1) / cosh(eta1))", "lon": f"({LON0!r}) + atan2(sinh(eta1), cos(xi1))"},
        {"lat": f"chi + {_sum(lat, 'sin({k} * chi)')}"},
        {"nu": f"{old.a!r} / sqrt(1 - {old.e2!r} * sin(lat) * sin(lat))"},
        {"gx": "nu * cos(lat) * cos(lon)", "gy": "nu * cos(lat) * sin(lon)", "gz": f"nu * {1 - old.e2!r} * sin(lat)"},
        {
            "hx": f"({SHIFT_M[0]!r}) + {m!r} * (gx - ({rz!r}) * gy + ({ry!r}) * gz)",
            "hy": f"({SHIFT_M[1]!r}) + {m!r} * (({rz!r}) * gx + gy - ({rx!r}) * gz)",
            "hz": f"({SHIFT_M[2]!r}) + {m!r} * (-({ry!r}) * gx + ({rx!r}) * gy + gz)",
        },
        {"p": "sqrt(hx * hx + hy * hy)", "dlon": f"atan2(hy, hx) - ({LON0!r})"},
        {"theta": f"atan2(hz * {new.a!r}, p * {b!r})"},
        {"sn": f"sin(atan2(hz + {new.e2 / (1 - new.e2) * b!r} * pow(sin(theta), 3), p - {new.e2 * new.a!r} * pow(cos(theta), 3)))"},
        {"t": f"sinh(atanh(sn) - {root!r} * atanh({root!r} * sn))"},
        {"u": "atan2(t, cos(dlon))", "v": "atanh(sin(dlon) / sqrt(1 + t * t))"},
        {
            "east": f"{FALSE_EAST!r} + {scale!r} * (v + {_sum(fwd, 'cos({k} * u) * sinh({k} * v)')})",
            "north": f"{scale!r} * (u + {_sum(fwd, 'sin({k} * u) * cosh({k} * v)')})",
        },
    ]


def shift_planar(df: DataFrame, x: str, y: str, out_x: str, out_y: str) -> DataFrame:
    """Old-datum easting/northing columns -> new-datum columns; null coordinates stay null."""
    out = df.withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")})
    names = {"_x", "_y"}
    for step in shift_steps("_x", "_y"):
        out = out.withColumns({f"_{name}": F.expr(_prefixed(formula, names)) for name, formula in step.items()})
        names |= {f"_{name}" for name in step}
    return out.select(*df.columns, F.col("_east").alias(out_x), F.col("_north").alias(out_y))


def _prefixed(formula: str, names: set[str]) -> str:
    """Own names get an underscore, so that columns of the input cannot clash with them."""
    return re.sub(r"\b[a-z][a-z0-9]*\b", lambda w: f"_{w[0]}" if f"_{w[0]}" in names else w[0], formula)


def shift_sql(source: str, x: str, y: str) -> str:
    """The same formulas as nested SQL over a query that gives ``x`` and ``y``."""
    sql = source
    for step in shift_steps(x, y):
        sql = f"SELECT *, {', '.join(f'{formula} AS {name}' for name, formula in step.items())} FROM ({sql})"
    return sql
