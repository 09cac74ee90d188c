"""Geometry on longitude and latitude: points as columns, rings as arrays of (x, y).

A geometry is polygons of rings of points. Folds stay in the JVM; clipping, segment
tests, canonical forms and simplification are Arrow functions on whole columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

RADIUS_KM = 6371.0088
#: Fixed value: latitude at which the square Mercator map ends.
MERCATOR_LAT = 85.05112878
RING = "array<struct<x:double,y:double>>"
GEOM = f"array<array<{RING}>>"
#: The same as an object: Arrow functions are made in workers, where no session parses text.
GEOM_TYPE = ArrayType(ArrayType(ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))))


def wrapped(lon: Column) -> Column:
    """G1: longitude in [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres along the sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(wrapped(lon2 - lon1)) / 2), 2
    )
    return F.lit(2 * RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def grid_row(lat: Column, size: int = 5) -> Column:
    """Row of a degree grid, the poles in the outer rows."""
    return F.greatest(F.lit(0), F.least(F.lit(180 // size - 1), F.floor((lat + 90) / size))).cast("int")


def grid_column(lon: Column, size: int = 5) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(360 // size - 1), F.floor((wrapped(lon) + 180) / size))).cast("int")


def row_distance(lat: Column, row: Column, size: int = 5) -> Column:
    """Least kilometres from a latitude to a grid row."""
    low, high = row * size - 90, row * size - 90 + size
    gap = F.greatest(F.lit(0.0), low - lat, lat - high)
    return F.radians(gap) * RADIUS_KM


def mercator_x(lon: Column) -> Column:
    """Map x in [0, 1]."""
    return (lon + 180) / 360


def mercator_y(lat: Column) -> Column:
    """Map y in [0, 1], north is 0; ln(tan + sec) is asinh(tan)."""
    r = F.radians(F.greatest(F.lit(-MERCATOR_LAT), F.least(F.lit(MERCATOR_LAT), lat)))
    return (1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y))))


def points(geometry: Column) -> Column:
    """All points of a geometry."""
    return F.flatten(F.flatten(geometry))


def bounds(geometry: Column) -> dict[str, Column]:
    """Box of a geometry."""
    p = points(geometry)
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}


def orientation(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """1 left of the line from a to b, -1 right of it, 0 on it within the smallest orientation that counts."""
    cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    return F.when(F.abs(cross) < 1e-12, 0).otherwise(F.signum(cross)).cast("int")


def span(ring: Column) -> dict[str, Column]:
    """Width and height of a ring in degrees, across the antimeridian too."""
    xs, ys = F.transform(unwrapped(ring), lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"x": F.array_max(xs) - F.array_min(xs), "y": F.array_max(ys) - F.array_min(ys)}


def vertices(geometry: Column) -> Column:
    """Number of points."""
    return F.size(points(geometry))


def unwrapped(ring: Column) -> Column:
    """Each longitude within half a turn of the one before."""
    start = F.struct(F.lit(None).cast("double").alias("at"), F.array().cast(RING).alias("out"))

    def step(acc, p):
        x = F.when(acc["at"].isNull(), p["x"]).otherwise(acc["at"] + wrapped(p["x"] - acc["at"]))
        return F.struct(x.alias("at"), F.array_append(acc["out"], F.struct(x.alias("x"), p["y"].alias("y"))).alias("out"))

    return F.aggregate(ring, start, step, lambda acc: acc["out"])


def ring_area(ring: Column) -> Column:
    """Signed area in square degrees, anticlockwise positive; each longitude within half a turn of the one before."""
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("x"), none.alias("y"), F.lit(0.0).alias("twice"))

    def step(acc, p):
        ahead = p["x"] - acc["x"]
        turns = F.when(ahead > 180, F.ceil((ahead - 180) / 360)).when(ahead < -180, -F.ceil((-ahead - 180) / 360)).otherwise(F.lit(0))
        x = F.when(acc["x"].isNull(), p["x"]).otherwise(p["x"] - 360 * turns)
        cross = F.when(acc["x"].isNull(), F.lit(0.0)).otherwise(acc["x"] * p["y"] - x * acc["y"])
        return F.struct(x.alias("x"), p["y"].alias("y"), (acc["twice"] + cross).alias("twice"))

    return F.aggregate(ring, start, step, lambda acc: acc["twice"] / 2)


def wound(geometry: Column, reject_flat: bool = False) -> Column:
    """Outer rings anticlockwise, holes clockwise; with reject_flat null for a geometry with a ring of no area."""
    turned = F.transform(
        geometry,
        lambda polygon: F.transform(polygon, lambda ring, i: F.when((ring_area(ring) > 0) == (i == 0), ring).otherwise(F.reverse(ring))),
    )
    return F.when(~F.exists(F.flatten(geometry), lambda r: ring_area(r) == 0), turned) if reject_flat else turned


def centroid(geometry: Column) -> tuple[Column, Column]:
    """Circular mean longitude and mean latitude of the outer rings' points, six decimals, no minus zero."""
    outer = F.flatten(F.transform(geometry, lambda p: F.slice(p[0], 1, F.greatest(F.size(p[0]) - 1, F.lit(0)))))
    total = lambda f: F.aggregate(outer, F.lit(0.0), lambda s, q: s + f(q))
    lon = F.degrees(F.atan2(total(lambda q: F.sin(F.radians(q["x"]))), total(lambda q: F.cos(F.radians(q["x"])))))
    n = F.size(outer)
    lat = F.when(n > 0, total(lambda q: q["y"]) / n)
    return F.when(n > 0, F.round(lon, 6) + F.lit(0.0)), F.round(lat, 6) + F.lit(0.0)


def fixed(v: Column, decimals: int) -> Column:
    """A number of so many decimals, rounded as JavaScript's toFixed: by its exact binary value, half away from zero."""
    scale = 10**decimals
    size = F.abs(v)
    p = size * scale
    # size is high + low of 26 bits each, so that their products are exact and error is what p was rounded by
    high = size * 134217729.0 - (size * 134217729.0 - size)
    error = (high * scale - p) + (size - high) * scale
    over = p - F.floor(p) - 0.5
    n = F.floor(p) + F.when((over > 0) | ((over == 0) & (error >= 0)), F.lit(1)).otherwise(F.lit(0))
    digits = F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(decimals + 1)), F.lit("0"))
    out = F.concat(F.when(v < 0, "-").otherwise(""), F.substring(digits, F.lit(1), F.length(digits) - decimals), F.lit("."), F.right(digits, F.lit(decimals)))
    return F.when(size < 1e9, out).otherwise(F.format_string(f"%.{decimals}f", v))


def svg_path(geometry: Column, decimals: int = 3) -> Column:
    """M x y L x y ... Z for every ring."""
    number = lambda v: fixed(v, decimals)
    ring = lambda r: F.concat(F.lit("M"), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"]))), "L"), F.lit("Z"))
    return F.array_join(F.transform(F.flatten(geometry), ring), "")


def quantised(ring: Column, scale: float = 1e5) -> Column:
    """K9: points on an integer grid as differences from the point before."""
    grid = F.transform(ring, lambda p: F.struct(F.round(p["x"] * scale).cast("bigint").alias("x"), F.round(p["y"] * scale).cast("bigint").alias("y")))
    before = F.concat(F.array(F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"))), F.slice(grid, 1, F.size(grid) - 1))
    return F.zip_with(grid, before, lambda a, b: F.struct((a["x"] - b["x"]).alias("x"), (a["y"] - b["y"]).alias("y")))


def arc_points(arc: Column, scale: float = 1e-5) -> Column:
    """Points of a delta-encoded arc (prefix sums)."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("x"), zero.alias("y"), F.array().cast(RING).alias("out"))

    def step(acc, p):
        x, y = acc["x"] + p["x"], acc["y"] + p["y"]
        return F.struct(x.alias("x"), y.alias("y"), F.array_append(acc["out"], F.struct((x * F.lit(scale)).alias("x"), (y * F.lit(scale)).alias("y"))).alias("out"))

    return F.aggregate(arc, start, step, lambda acc: acc["out"])


def problems(geometry: Column) -> Column:
    """Codes of everything wrong with a geometry, in order, each once; empty if nothing is.

    A null geometry has no type. A ring of fewer than four points, or with a coordinate
    that is null, no number or off the globe, is not looked at further.
    """
    off = lambda v, m: v.isNull() | F.isnan(v) | (F.abs(v) > m)
    broken = lambda r: F.exists(r, lambda q: q.isNull() | off(q["x"], 180.0) | off(q["y"], 90.0))
    ends = lambda r: (F.element_at(r, 1), F.element_at(r, -1))
    rings = F.flatten(F.filter(geometry, lambda p: p.isNotNull()))
    short = lambda r: r.isNull() | (F.size(r) < 4)
    sound = F.filter(rings, lambda r: ~short(r) & ~F.coalesce(broken(r), F.lit(False)))
    checks = {
        "COORDINATE_INVALID": F.exists(F.filter(rings, lambda r: ~short(r)), broken),
        "GEOMETRY_EMPTY": (F.size(geometry) == 0) | F.exists(geometry, lambda p: p.isNull() | (F.size(p) == 0)),
        "RING_NOT_CLOSED": F.exists(sound, lambda r: (ends(r)[0]["x"] != ends(r)[1]["x"]) | (ends(r)[0]["y"] != ends(r)[1]["y"])),
        "RING_TOO_SHORT": F.exists(rings, short),
        "RING_ZERO_AREA": F.exists(sound, lambda r: ring_area(r) == 0),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in checks.items()]), lambda x: x.isNotNull())
    return F.when(geometry.isNull(), F.array(F.lit("GEOMETRY_TYPE_INVALID"))).otherwise(found)


def _decoded(column: pa.Array) -> list:
    """Geometries of a column as polygons of rings [points, 2], null ones None; points are views of two flat arrays."""
    polygons, outer = column.values, column.offsets.to_numpy()
    rings, middle = polygons.values, polygons.offsets.to_numpy()
    flat, inner = rings.values, rings.offsets.to_numpy()
    xy = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in flat.flatten()]) if len(flat) else np.empty((0, 2))
    null = column.is_null().to_numpy(zero_copy_only=False)
    ring = lambda r: xy[inner[r] : inner[r + 1]]
    return [
        None if null[i] else [[ring(r) for r in range(middle[p], middle[p + 1])] for p in range(outer[i], outer[i + 1])] for i in range(len(column))
    ]


def _encoded(geometries: list) -> pa.Array:
    """The column of geometries as _decoded gives them."""
    polygons = [p for g in geometries if g is not None for p in g]
    rings = [r for p in polygons for r in p]
    ends = lambda parts: pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32))
    xy = np.concatenate(rings) + 0.0 if rings else np.empty((0, 2))
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in (0, 1)], ["x", "y"])
    nested = pa.ListArray.from_arrays(ends(polygons), pa.ListArray.from_arrays(ends(rings), points))
    null = pa.array([g is None for g in geometries], pa.bool_())
    return pa.ListArray.from_arrays(ends([() if g is None else g for g in geometries]), nested, mask=null)


def _each(one, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """A function of geometries over their columns; null where one is null."""
    return pa.array([None if any(g is None for g in row) else one(*row) for row in zip(*map(_decoded, columns))], kind)


def _each_shape(one, column: pa.Array) -> pa.Array:
    """A function from geometry to geometry over a column; null stays null."""
    return _encoded([None if g is None else one(g) for g in _decoded(column)])


def unwrap(ring: np.ndarray) -> np.ndarray:
    out = ring.copy()
    step = np.diff(ring[:, 0])
    out[1:, 0] = ring[0, 0] + np.cumsum(step - 360 * np.round(step / 360))
    return out


BOX_TYPE = StructType([StructField(n, DoubleType()) for n in ("min_x", "min_y", "max_x", "max_y")])


@arrow_udf(BOX_TYPE)
def unwrapped_box(s: pa.Array) -> pa.Array:
    """A12 without the jump of longitudes: the box of all rings, each followed the short way round; null for no point."""

    def one(geometry):
        rings = [unwrap(r) for p in geometry for r in p if len(r)]
        if not rings:
            return None
        low, high = np.min([r.min(axis=0) for r in rings], axis=0), np.max([r.max(axis=0) for r in rings], axis=0)
        return {"min_x": float(low[0]), "min_y": float(low[1]), "max_x": float(high[0]), "max_y": float(high[1])}

    return _each(one, pa.struct([(n, pa.float64()) for n in ("min_x", "min_y", "max_x", "max_y")]), s)


def clip(ring: np.ndarray, x: float, keep_right: bool) -> np.ndarray:
    """The part of a closed ring on one side of a meridian."""
    out = []
    for a, b in zip(ring[:-1], ring[1:]):
        ia, ib = ((v[0] >= x) if keep_right else (v[0] <= x) for v in (a, b))
        if ia:
            out.append(a)
        if ia != ib:
            t = (x - a[0]) / (b[0] - a[0])
            out.append(np.array([x, a[1] + t * (b[1] - a[1])]))
    if len(out) < 3:
        return np.empty((0, 2))
    return np.array(out + [out[0]])


@arrow_udf(GEOM_TYPE)
def split_at_antimeridian(s: pa.Array) -> pa.Array:
    """Polygons cut at the antimeridian so that every part lies in -180..180; null stays null."""

    def one(geometry):
        out = []
        for polygon in geometry:
            rings = [unwrap(r) for r in polygon if len(r) >= 4]
            if not rings:
                continue
            low, high = rings[0][:, 0].min(), rings[0][:, 0].max()
            if low >= -180 and high <= 180:
                out.append(rings)
                continue
            for k in range(math.floor((low + 180) / 360), math.floor((high + 180) / 360) + 1):
                west = -180 + 360 * k
                part = []
                for r in rings:
                    c = clip(clip(r, west, True), west + 360, False) if len(r) >= 4 else r
                    if len(c) >= 4:
                        part.append(c - np.array([360.0 * k, 0.0]))
                    elif not part:
                        break
                if part:
                    out.append(part)
        return out

    return _each_shape(one, s)


@arrow_udf(StringType())
def canonical(s: pa.Array) -> pa.Array:
    """Text that is equal for equal geometries whatever the start, direction or order of their rings."""

    def ring_text(r):
        r = unwrap(r)[:-1] if len(r) > 1 else r
        r = np.round(r - np.array([360.0 * math.floor((r[:, 0].min() + 180) / 360), 0.0]), 9) + 0.0
        forms = []
        for way in (r, r[::-1]):
            start = min(range(len(way)), key=lambda i: tuple(way[i]))
            forms.append([tuple(map(float, p)) for p in np.roll(way, -start, axis=0)])
        return repr(min(forms))

    def one(geometry):
        return repr(sorted([[ring_text(p[0]), *sorted(ring_text(h) for h in p[1:])] for p in geometry if p and all(len(r) for r in p)]))

    return _each(one, pa.string(), s)


#: Edge and point, or edge and edge, that are looked at at once: bounds the memory of the tests below.
MEETINGS = 1_000_000
#: Fixed value: an orientation below this is none.
FLAT = 1e-12


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which side of the lines a-b the points c lie on, row by row: 1 left, -1 right, 0 on it."""
    cross = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    return np.where(np.abs(cross) < FLAT, 0.0, np.sign(cross))


def _meetings(first: np.ndarray, last: np.ndarray):
    """(row, place) of every place in first..last of each row, in pieces of about MEETINGS."""
    n = np.maximum(last - first, 0)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MEETINGS, "right")))
        rows = np.repeat(np.arange(at, to), n[at:to])
        yield rows, np.repeat(first[at:to], n[at:to]) + np.arange(len(rows)) - np.repeat(np.cumsum(n[at:to]) - n[at:to], n[at:to])
        at = to


def in_ring(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """G11 for many points: 1 inside, 0 on the ring, -1 outside.

    Points are sorted by latitude, so that an edge meets only those of its latitudes.
    """
    out = np.full(len(points), -1)
    if len(ring) < 2 or not len(points):
        return out
    a, b = ring[:-1], ring[1:]
    order = np.argsort(points[:, 1], kind="stable")
    p = points[order]
    low, high = np.minimum(a, b) - FLAT, np.maximum(a, b) + FLAT
    crossings, on = np.zeros(len(p), np.int64), np.zeros(len(p), bool)
    for e, i in _meetings(np.searchsorted(p[:, 1], low[:, 1], "left"), np.searchsorted(p[:, 1], high[:, 1], "right")):
        x, y = p[i, 0], p[i, 1]
        beside = (x >= low[e, 0]) & (x <= high[e, 0])
        on[i[beside][_turn(a[e[beside]], b[e[beside]], p[i[beside]]) == 0]] = True
        meets = (a[e, 1] > y) != (b[e, 1] > y)
        e, i = e[meets], i[meets]
        at = a[e, 0] + (p[i, 1] - a[e, 1]) * (b[e, 0] - a[e, 0]) / (b[e, 1] - a[e, 1])
        crossings += np.bincount(i[p[i, 0] < at], minlength=len(p))
    out[order] = np.where(on, 0, np.where(crossings % 2 == 1, 1, -1))
    return out


def in_polygon(points: np.ndarray, polygon: list[np.ndarray]) -> np.ndarray:
    """1 within the outer ring and outside all holes, 0 on a ring, else -1."""
    at = in_ring(points, polygon[0])
    for hole in polygon[1:]:
        inside = np.flatnonzero(at == 1)
        at[inside] = -in_ring(points[inside], hole)
    return at


def polygons_overlap(one: list[np.ndarray], two: list[np.ndarray]) -> bool:
    """A proper crossing of edges, or a vertex of one strictly inside the other.

    Only edges and vertices within both boxes are looked at; edges of one side are sorted
    by their west end, so that an edge meets those it can reach.
    """
    low = np.maximum(one[0].min(axis=0), two[0].min(axis=0))
    high = np.minimum(one[0].max(axis=0), two[0].max(axis=0))

    def edges(polygon):
        a, b = np.concatenate([r[:-1] for r in polygon]), np.concatenate([r[1:] for r in polygon])
        near = ((np.minimum(a, b) <= high) & (np.maximum(a, b) >= low)).all(axis=1)
        return a[near], b[near]

    (a, b), (c, d) = edges(one), edges(two)
    if len(a) and len(c):
        order = np.argsort(np.minimum(c[:, 0], d[:, 0]), kind="stable")
        c, d = c[order], d[order]
        west, east = np.minimum(c[:, 0], d[:, 0]), np.maximum(c[:, 0], d[:, 0])
        # the furthest east any edge so far reaches: before it comes to an edge's west end, none meets it
        reach = np.maximum.accumulate(east)
        for i, j in _meetings(np.searchsorted(reach, np.minimum(a[:, 0], b[:, 0]), "left"), np.searchsorted(west, np.maximum(a[:, 0], b[:, 0]), "right")):
            near = (np.minimum(a[i, 1], b[i, 1]) <= np.maximum(c[j, 1], d[j, 1])) & (np.minimum(c[j, 1], d[j, 1]) <= np.maximum(a[i, 1], b[i, 1]))
            near &= east[j] >= np.minimum(a[i, 0], b[i, 0])
            i, j = i[near], j[near]
            if ((_turn(a[i], b[i], c[j]) * _turn(a[i], b[i], d[j]) < 0) & (_turn(c[j], d[j], a[i]) * _turn(c[j], d[j], b[i]) < 0)).any():
                return True
    for own, other in ((one, two), (two, one)):
        v = own[0][:-1]
        v = v[((v >= low) & (v <= high)).all(axis=1)]
        if (in_polygon(v, other) == 1).any():
            return True
    return False


def _together(polygon: list[np.ndarray]) -> list[np.ndarray]:
    """Rings of at least four points without jumps of longitude, holes in the turn of their outer ring."""
    rings = [unwrap(r) for r in polygon if len(r) >= 4]
    middle = lambda r: (r[:, 0].min() + r[:, 0].max()) / 2
    return rings[:1] + [r - np.array([360.0 * round((middle(r) - middle(rings[0])) / 360), 0.0]) for r in rings[1:]]


@arrow_udf(BooleanType())
def overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    """G12 for two geometries, shifted by whole turns where they cross the antimeridian; null if one is null."""

    def one(x, y):
        xs, ys = ([_together(p) for p in g] for g in (x, y))
        for p in xs:
            for q in ys:
                for turn in (-360.0, 0.0, 360.0):
                    if p and q:
                        moved = [r + np.array([turn, 0.0]) for r in q]
                        if (p[0].min(axis=0) < moved[0].max(axis=0)).all() and (moved[0].min(axis=0) < p[0].max(axis=0)).all() and polygons_overlap(p, moved):
                            return True
        return False

    return _each(one, pa.bool_(), a, b)


def kept_points(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points Douglas-Peucker keeps, with a stack; ends stay, a ring keeps four points."""
    keep = np.zeros(len(ring), dtype=bool)
    far = int(np.argmax(((ring - ring[0]) ** 2).sum(axis=1)))
    keep[[0, far, len(ring) - 1]] = True
    stack = [(0, far), (far, len(ring) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        a, d, mid = ring[i], ring[j] - ring[i], ring[i + 1 : j] - ring[i]
        length = math.hypot(*d)
        dist = np.abs(d[0] * mid[:, 1] - d[1] * mid[:, 0]) / length if length else np.hypot(mid[:, 0], mid[:, 1])
        k = int(np.argmax(dist))
        if dist[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep if keep.sum() >= 4 else np.ones(len(ring), dtype=bool)


def simplify_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    return ring[kept_points(ring, tolerance)]


def _mercator(ring: np.ndarray) -> np.ndarray:
    """G5 for a ring: unwrapped longitudes and projected latitudes, in turns of the globe."""
    r = np.radians(np.clip(ring[:, 1], -MERCATOR_LAT, MERCATOR_LAT))
    return np.column_stack([unwrap(ring)[:, 0] / 360 + 0.5, (1 - np.arcsinh(np.tan(r)) / math.pi) / 2])


def simplified(tolerance: float, projected: bool = False):
    """G18 for whole geometries; null stays null. Distances are degrees, or, projected, turns on the square map."""

    @arrow_udf(GEOM_TYPE)
    def run(s: pa.Array) -> pa.Array:
        def ring(r):
            if len(r) <= 4:
                return r
            return r[kept_points(_mercator(r) if projected else r, tolerance)]

        return _each_shape(lambda g: [[ring(r) for r in p] for p in g], s)

    return run


def visvalingam(ring: np.ndarray, least: float) -> np.ndarray:
    """A closed ring without the points whose triangle with their neighbours is below ``least``, smallest first.

    A point's area never falls below that of one taken out before it, so that the order
    of thresholds is kept; a ring keeps four points.
    """
    import heapq

    n = len(ring) - 1
    if n <= 3:
        return ring
    x, y = ring[:n, 0].tolist(), ring[:n, 1].tolist()
    before, after = [(i - 1) % n for i in range(n)], [(i + 1) % n for i in range(n)]

    def area(i):
        a, b = before[i], after[i]
        return abs((x[a] - x[i]) * (y[b] - y[i]) - (x[b] - x[i]) * (y[a] - y[i])) / 2

    now = [area(i) for i in range(n)]
    heap = [(v, i) for i, v in enumerate(now)]
    heapq.heapify(heap)
    left, alive = n, [True] * n
    while heap and left > 3:
        v, i = heapq.heappop(heap)
        if not alive[i] or v != now[i]:
            continue
        if v >= least:
            break
        alive[i] = False
        left -= 1
        a, b = before[i], after[i]
        after[a], before[b] = b, a
        for k in (a, b):
            now[k] = max(area(k), v)
            heapq.heappush(heap, (now[k], k))
    kept = np.flatnonzero(alive)
    return ring[np.append(kept, kept[0])]


def presimplified(least: float):
    """G19 for whole geometries; null stays null."""

    @arrow_udf(GEOM_TYPE)
    def run(s: pa.Array) -> pa.Array:
        return _each_shape(lambda g: [[visvalingam(r, least) if len(r) > 4 else r for r in p] for p in g], s)

    return run
