"""Points near other points, and the regions that contain points.

Distances: positions become unit vectors; k-d splits of a bounded sample part space
into cells; every row goes to the cell that holds it and, as a halo copy, to cells
within the chord radius; each cell answers its own points with a local k-d tree.
Regions: the same splits over longitude and latitude; a polygon that meets several
cells goes down the splits and is clipped at each, so that a cell gets the part of its
edges that matters there; in a cell, a sweep in longitude order keeps the active edges
and settles the points it passes.

Scale: one shuffle of narrow rows by cell. The driver holds the sample (at most twice
``SAMPLE`` rows or four a cell) and counts of heavy cells. A cell with more than
``BLOCK`` rows or points of polygons, which k-d splits could not part (a hot place), is
joined in blocks of both sides, so that no task holds more than two blocks; no pair is
lost. Placed rows are cut once, as counting and joining read them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartomill import runtime
from cartomill.functions.kdtree import KdTree, assign, fit_cells

RADIUS_KM = 6371.0088
#: Rows of the sample that places the splits; rows meant for a cell; rows of one side in a task.
SAMPLE, CELL_ROWS, BLOCK = 40_000, 6_000, 30_000
#: Most cells, a few megabytes of splits; points of polygons in a task; points a sweep passes at once.
MOST_CELLS, BLOCK_POINTS, STRIP = 65_536, 1_000_000, 256
#: Degrees from an edge that count as on it, and degrees beyond its cell that a clipped part reaches.
EDGE, MARGIN = 1e-9, 1e-6


def chord(km: float) -> float:
    """Length in units of the radius of the chord under an arc."""
    return 2 * math.sin(km / (2 * RADIUS_KM))


def usable(lat: Column, lon: Column) -> Column:
    """Numbers on the globe; null and NaN are not."""
    return F.coalesce(
        ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False)
    )


def vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Unit vectors [rows, 3] of positions."""
    a, o = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)])


def cells_for(rows: int) -> int:
    """How many cells so many rows are spread over."""
    return min(MOST_CELLS, max(1, -(-rows // CELL_ROWS)))


def sample_rows(df: DataFrame, total: int, *cols: str) -> np.ndarray:
    """A bounded, repeatable sample: rows of least hash of the key."""
    size = max(SAMPLE, 4 * cells_for(total))
    limit = int(min(1.0, size / max(total, 1)) * (1 << 30))
    rows = df.where(F.pmod(F.xxhash64("key", F.lit(17)), F.lit(1 << 30)) < limit).select(*cols).limit(2 * size).collect()
    return np.array([tuple(r) for r in rows], dtype=float).reshape(-1, len(cols))


def spread(placed: DataFrame, weight: Column | None = None, most: int | None = None, block: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Rows with the ``task`` they meet in: a cell, or a pair of blocks of a heavy one.

    placed: ``cell``, ``key``, ``asks`` and ``answers``; a row may do both. Every asking
    row of a cell meets every answering one in exactly one task. A cell is heavy with
    more than ``block`` (BLOCK) rows of a side, or more than ``most`` of the weight that
    answers. counted: ``cell``, ``asks`` and ``answers`` of at least these rows, where
    they are cheaper to count than ``placed``.
    """
    block, most = block or BLOCK, most or max(BLOCK_POINTS, block or 0)
    w = F.lit(1) if weight is None else weight
    asking, answering = F.count_if("asks"), F.count_if("answers")
    load = F.sum(F.when(F.col("answers"), w).otherwise(0))
    heavy = (placed if counted is None else counted).groupBy("cell").agg(asking.alias("a"), answering.alias("b"), load.alias("w")).where(
        (F.col("a") > block) | (F.col("b") > block) | (F.col("w") > most)
    ).collect()  # one row a heavy cell
    if not heavy:
        return placed.withColumn("task", F.concat_ws("/", F.col("cell").cast("string"), F.lit("0"), F.lit("0")))
    parts = {r.cell: (max(1, -(-r.a // block)), max(1, -(-r.b // block), -(-int(r.w) // most))) for r in heavy}
    n = [F.coalesce(F.create_map(*[F.lit(x) for c, v in parts.items() for x in (c, v[i])])[F.col("cell")], F.lit(1)) for i in (0, 1)]
    own = [F.pmod(F.xxhash64("key", F.lit(5)), n[i]).cast("int") for i in (0, 1)]
    single = (n[0] == 1) & (n[1] == 1)
    at = lambda i, j: F.concat_ws("/", F.col("cell").cast("string"), i.cast("string"), j.cast("string"))
    role = lambda task, asks, answers: F.struct(task.alias("task"), asks.alias("asks"), answers.alias("answers"))
    both = F.array(role(at(F.lit(0), F.lit(0)), F.col("asks"), F.col("answers")))
    ask = F.transform(F.sequence(F.lit(0), n[1] - 1), lambda j: role(at(own[0], j), F.lit(True), F.lit(False)))
    answer = F.transform(F.sequence(F.lit(0), n[0] - 1), lambda i: role(at(i, own[1]), F.lit(False), F.lit(True)))
    none = F.filter(both, lambda r: F.lit(False))
    roles = F.when(single, both).otherwise(F.concat(F.when(F.col("asks"), ask).otherwise(none), F.when(F.col("answers"), answer).otherwise(none)))
    others = [c for c in placed.columns if c not in ("asks", "answers")]
    return placed.withColumn("_role", F.explode(roles)).select(*others, "_role.asks", "_role.answers", "_role.task")


def within(asking: DataFrame, answering: DataFrame | None, km: float) -> DataFrame:
    """Pairs (key_a, key_b) of rows at most km apart on the sphere, from (key, lat, lon).

    ``answering`` None: the asking rows answer themselves and are sent once for both.
    Keys are strings, one row per key. Rows whose position is null, NaN or off the
    globe pair with nothing. Positions at equal places pair; a key pairs with the same
    key on the other side, if it has one. Empty tables give no rows.
    """
    runtime.ship_package(asking.sparkSession)
    sides = [
        df.where(usable(F.col("lat"), F.col("lon"))).select(F.col("key").cast("string").alias("key"), "lat", "lon", F.lit(i != 1).alias("asks"), F.lit(i != 0).alias("answers"))
        for i, df in (((2, asking),) if answering is None else ((0, asking), (1, answering)))
    ]
    both = sides[0] if answering is None else sides[0].unionByName(sides[1])
    total = both.count()
    r = chord(km)
    pad = r * (1 + 1e-9)
    sample = sample_rows(both, total, "lat", "lon")
    nodes = fit_cells(vectors(sample[:, 0], sample[:, 1]), cells_for(total))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            xyz = vectors(b["lat"].to_numpy(), b["lon"].to_numpy())
            # who asks goes to its own cell, who answers also to cells within the radius
            answers = b["answers"].to_numpy(dtype=bool)
            reach = np.where(answers, pad, 0.0)[:, None]
            rows, cell = assign(nodes, xyz - reach, xyz + reach)
            own = np.empty(len(b), dtype=np.int64)
            at, home = assign(nodes, xyz, xyz)
            own[at] = home
            out = b.iloc[rows][["key"]].copy()
            out["asks"] = b["asks"].to_numpy(dtype=bool)[rows] & (own[rows] == cell)
            out["answers"] = answers[rows]
            out["cell"] = cell.astype("int32")
            for i, axis in enumerate("xyz"):
                out[axis] = xyz[rows, i]
            yield out

    placed = runtime.cut(both.mapInPandas(place, "key string, asks boolean, answers boolean, cell int, x double, y double, z double"))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.asks], pdf[pdf.answers]
        tree = KdTree(b[["x", "y", "z"]].to_numpy())
        ka, kb = a.key.to_numpy(), b.key.to_numpy()
        found = [(ka[i], kb[j]) for i, j in tree.pairs(a[["x", "y", "z"]].to_numpy(), r)]
        if not found:
            return pd.DataFrame({"key_a": [], "key_b": []}, dtype=object)
        return pd.DataFrame({"key_a": np.concatenate([f[0] for f in found]), "key_b": np.concatenate([f[1] for f in found])})

    return spread(placed).groupBy("task").applyInPandas(local, "key_a string, key_b string")


def _edges(polygons: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Edges (left x, left y, right x, right y, ring) of all rings, and of each ring its polygon and whether it is the outer one."""
    parts, rings, polygon, outer = [], [], [], []
    for p, (xs, ys, lengths) in enumerate(polygons):
        at = 0
        for k, n in enumerate(lengths):
            x, y = xs[at : at + n], ys[at : at + n]
            at += n
            if n < 3:
                continue
            if x[0] != x[-1] or y[0] != y[-1]:
                x, y = np.append(x, x[0]), np.append(y, y[0])
            turn = x[1:] < x[:-1]
            parts.append(np.stack([np.where(turn, x[1:], x[:-1]), np.where(turn, y[1:], y[:-1]), np.where(turn, x[:-1], x[1:]), np.where(turn, y[:-1], y[1:])]))
            rings.append(np.full(len(turn), len(polygon)))
            polygon.append(p), outer.append(k == 0)
    if not parts:
        return None
    return (*np.concatenate(parts, axis=1), np.concatenate(rings), np.array(polygon), np.array(outer))


def _sweep(px: np.ndarray, py: np.ndarray, polygons: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """(polygon, point) index arrays of polygons that hold points; points are in order of px.

    The sweep goes from west to east, STRIP points at a time. Edges enter the active set
    where they begin and leave it where they end; an active edge meets the points of the
    strip between its ends. An edge above a point flips the side of its ring; a point
    within EDGE of an edge is on its ring. A point is settled when its strip is passed,
    so only the active edges and one strip's meetings are held.
    """
    none = np.empty(0, int)
    edges = _edges(polygons) if len(px) else None
    if edges is None:
        return none, none
    x1, y1, x2, y2, ring, ring_polygon, ring_outer = edges
    order = np.argsort(x1, kind="stable")
    x1, y1, x2, y2, ring = (v[order] for v in (x1, y1, x2, y2, ring))
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    top, bottom = np.full(len(ring_polygon), -np.inf), np.full(len(ring_polygon), np.inf)
    np.maximum.at(top, ring, high), np.minimum.at(bottom, ring, low)
    active, entered = np.empty(0, int), 0
    found = []
    for start in range(0, len(px), STRIP):
        sx, sy = px[start : start + STRIP], py[start : start + STRIP]
        stop = int(np.searchsorted(x1, sx[-1] + EDGE, "right"))
        active = np.concatenate([active, np.arange(entered, max(stop, entered))])
        entered = max(stop, entered)
        active = active[x2[active] >= sx[0] - EDGE]
        first, last = np.searchsorted(sx, x1[active] - EDGE, "left"), np.searchsorted(sx, x2[active] + EDGE, "right")
        n = last - first
        ends = np.cumsum(n)
        flips, touches = [], []
        at = 0
        while at < len(active):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000, "right")))
            k, c = active[at:to], n[at:to]
            e = np.repeat(k, c)
            pt = np.repeat(first[at:to], c) + np.arange(len(e)) - np.repeat(np.cumsum(c) - c, c)
            near = (sy[pt] >= bottom[ring[e]] - EDGE) & (sy[pt] <= top[ring[e]] + EDGE)
            e, pt = e[near], pt[near]
            dx, dy, ax, ay = x2[e] - x1[e], y2[e] - y1[e], sx[pt] - x1[e], sy[pt] - y1[e]
            length = np.hypot(dx, dy)
            cross, along = dx * ay - dy * ax, dx * ax + dy * ay
            on = (np.abs(cross) <= EDGE * np.maximum(length, EDGE)) & (along >= -EDGE * length) & (along <= length * (length + EDGE))
            above = (x1[e] <= sx[pt]) & (sx[pt] < x2[e]) & (cross < 0)
            key = ring[e].astype(np.int64) * len(sx) + pt
            flips.append(key[above]), touches.append(key[on])
            at = to
        if not flips:
            continue
        flip, times = np.unique(np.concatenate(flips), return_counts=True)
        odd = flip[times % 2 == 1]
        touch = np.unique(np.concatenate(touches))
        both = np.union1d(odd, touch)
        whole = lambda keys: ring_polygon[keys // len(sx)].astype(np.int64) * len(sx) + keys % len(sx)
        inside = np.unique(whole(both[ring_outer[both // len(sx)]]))
        hole = np.setdiff1d(odd[~ring_outer[odd // len(sx)]], touch)
        inside = np.setdiff1d(inside, whole(hole))
        found.append((inside // len(sx), inside % len(sx) + start))
    if not found:
        return none, none
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _half(x: np.ndarray, y: np.ndarray, axis: int, cut: float, low: bool) -> tuple[np.ndarray, np.ndarray]:
    """The part of a closed ring on one side of a line, closed; empty if there is none."""
    v, u = (x, y) if axis == 0 else (y, x)
    kept = v <= cut if low else v >= cut
    if kept.all():
        return x, y
    if not kept.any():
        return x[:0], y[:0]
    a, b = kept[:-1], kept[1:]
    met = a != b
    step = np.where(met, v[1:] - v[:-1], 1.0)
    # of every edge, first where it meets the line, then its end
    at_v = np.stack([np.full(len(a), cut), v[1:]], axis=1).ravel()
    at_u = np.stack([u[:-1] + (cut - v[:-1]) / step * (u[1:] - u[:-1]), u[1:]], axis=1).ravel()
    take = np.stack([met, b], axis=1).ravel()
    v, u = at_v[take], at_u[take]
    v, u = np.append(v, v[0]), np.append(u, u[0])
    return (v, u) if axis == 0 else (u, v)


def _clipped(nodes: list[tuple], rings: list[tuple[np.ndarray, np.ndarray]]):
    """(cell, rings) of every cell the outer ring, the first one, reaches; each holds what lies within MARGIN of it."""
    stack = [(0, rings)]
    while stack:
        at, own = stack.pop()
        node = nodes[at]
        if node[0] == -1:
            yield node[1], own
            continue
        axis, cut, left, right = node
        for child, line, low in ((left, cut + MARGIN, True), (right, cut - MARGIN, False)):
            parts = [_half(x, y, axis, line, low) for x, y in own]
            if len(parts[0][0]):
                stack.append((child, [r for r in parts if len(r[0])]))


def _unwrapped(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Longitudes without the jump: a step of more than 180 degrees goes the short way round."""
    out, at, centre = [], 0, None
    for n in lengths:
        ring = x[at : at + n]
        at += n
        step = np.diff(ring)
        turn = np.where(step > 180, -360.0, np.where(step < -180, 360.0, 0.0))
        if turn.any():
            ring = ring + np.concatenate([[0.0], np.cumsum(turn)])
        if n:
            mid = (ring.min() + ring.max()) / 2
            if centre is None:
                centre = mid
            elif abs(mid - centre) > 180:  # a hole lies in the world of its outer ring
                ring = ring - 360.0 * np.round((mid - centre) / 360.0)
        out.append(ring)
    return np.concatenate(out) if out else x


def containing(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Pairs (key_a, key_b): point key_a lies in area key_b or on its border.

    points: (key, lat, lon), one row per key; areas: (key, geometry), polygons of rings
    of points. Within a hole is outside, on its border inside; several polygons of an
    area count once. Polygons without an outer ring of three points, or with a null or
    not-finite coordinate, hold nothing; null geometry holds nothing.
    """
    runtime.ship_package(points.sparkSession)
    pts = points.where(usable(F.col("lat"), F.col("lon"))).select(
        F.col("key").cast("string").alias("key"), "lat", "lon"
    )
    total = pts.count()
    nodes = fit_cells(sample_rows(pts, total, "lon", "lat"), cells_for(total))
    polygons = areas.where(F.col("geometry").isNotNull()).select(
        F.col("key").cast("string").alias("key"), F.explode("geometry").alias("_polygon")
    ).select(
        "key",
        F.transform(F.flatten("_polygon"), lambda p: p["x"]).alias("xs"),
        F.transform(F.flatten("_polygon"), lambda p: p["y"]).alias("ys"),
        F.transform("_polygon", lambda r: F.size(r)).alias("lengths"),
    )
    schema = "key string, cell int, x double, y double, xs array<double>, ys array<double>, lengths array<int>"

    def place_points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = b[["lon", "lat"]].to_numpy(dtype=float)
            rows, cell = assign(nodes, at, at)
            nothing = [None] * len(rows)
            yield pd.DataFrame({"key": b["key"].to_numpy()[rows], "cell": cell.astype("int32"), "x": at[rows, 0], "y": at[rows, 1], "xs": nothing, "ys": nothing, "lengths": nothing})

    def place_polygons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shapes, low, high = [], [], []
            for key, x, y, lengths in zip(b["key"], b["xs"], b["ys"], b["lengths"]):
                if x is None or y is None or lengths is None or not len(lengths) or lengths[0] < 3:
                    continue
                x, y, lengths = np.array(x, float), np.array(y, float), np.array(lengths, int)
                if not (np.isfinite(x).all() and np.isfinite(y).all()) or (lengths < 0).any():
                    continue
                x = _unwrapped(x, lengths)
                for turn in (-360.0, 0.0, 360.0):
                    moved = x + turn
                    if moved.min() > 180 + EDGE or moved.max() < -180 - EDGE:
                        continue
                    shapes.append((key, moved, y, lengths))
                    low.append((moved.min() - EDGE, y.min() - EDGE)), high.append((moved.max() + EDGE, y.max() + EDGE))
            if not shapes:
                continue
            rows, cell = assign(nodes, np.array(low), np.array(high))
            times = np.bincount(rows, minlength=len(shapes))
            out = [(shapes[i][0], int(c), *shapes[i][1:]) for i, c in zip(rows, cell) if times[i] == 1]
            for i in np.flatnonzero(times > 1):
                key, x, y, lengths = shapes[i]
                ends = np.cumsum(lengths)
                rings = [_closed(x[e - n : e], y[e - n : e]) for e, n in zip(ends, lengths) if n >= 3]
                for c, own in _clipped(nodes, rings):
                    out.append((key, int(c), np.concatenate([r[0] for r in own]), np.concatenate([r[1] for r in own]), np.array([len(r[0]) for r in own])))
            keys, cell, xs, ys, ls = zip(*out)
            none = np.full(len(keys), np.nan)
            yield pd.DataFrame({"key": keys, "cell": np.array(cell, "int32"), "x": none, "y": none, "xs": xs, "ys": ys, "lengths": ls})

    side = lambda df, asks: df.withColumn("asks", F.lit(asks)).withColumn("answers", F.lit(not asks))
    placed = runtime.cut(side(pts.mapInPandas(place_points, schema), True).unionByName(side(polygons.mapInPandas(place_polygons, schema), False)))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.asks], pdf[pdf.answers]
        none = pd.DataFrame({"key_a": [], "key_b": []}, dtype=object)
        if not len(a) or not len(b):
            return none
        px, py = a["x"].to_numpy(float), a["y"].to_numpy(float)
        order = np.argsort(px, kind="stable")
        poly, pt = _sweep(px[order], py[order], list(zip(b["xs"], b["ys"], b["lengths"])))
        if not len(poly):
            return none
        return pd.DataFrame({"key_a": a.key.to_numpy()[order][pt], "key_b": b.key.to_numpy()[poly]}).drop_duplicates()

    return spread(placed, F.coalesce(F.size("xs"), F.lit(0))).groupBy("task").applyInPandas(local, "key_a string, key_b string").distinct()


def _closed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x, y) if x[0] == x[-1] and y[0] == y[-1] else (np.append(x, x[0]), np.append(y, y[0]))


def found(cities: DataFrame, areas: DataFrame, near_km: float = 3.0, centre_km: float = 1.5) -> DataFrame:
    """relation_kind, city_id, other_key of the three relations; repeated rows count once."""
    places = cities.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("key"), "lat", "lon").distinct()
    # three joins read the places: distinct ones are written once
    places = runtime.cut(places)
    near = within(places, None, near_km)
    low, high = F.col("key_a").cast("bigint"), F.col("key_b").cast("bigint")
    near = near.where(low < high).select(F.lit("near").alias("relation_kind"), low.alias("city_id"), F.col("key_b").alias("other_key")).distinct()
    regions = areas.where(F.col("areaId").isNotNull()).select(
        F.col("areaId").alias("key"), "geometry", F.col("centroid.y").alias("lat"), F.col("centroid.x").alias("lon")
    )
    centres = regions.select("key", "lat", "lon").distinct()
    named = lambda df, kind: df.select(F.lit(kind).alias("relation_kind"), F.col("key_a").cast("bigint").alias("city_id"), F.col("key_b").alias("other_key"))
    centre = named(within(places, centres, centre_km), "centre").distinct()
    inside = named(containing(places, regions.select("key", "geometry").dropDuplicates(["key"])), "inside")
    return near.unionByName(inside).unionByName(centre)
