"""Distance joins and counts that a dense place does not slow down (J-05, J-06).

Points become vectors on the unit sphere, where a great-circle distance is a
chord and neither the poles nor the antimeridian are special.  They are put in
z-order and cut into blocks of ``BLOCK`` points, eight blocks make a node, eight
nodes the next one: every node has a tight box, and no key holds more than a
block or eight nodes, however the points lie.

Two such trees are walked down together.  A pair of nodes whose boxes are too
far apart goes; if the boxes are wholly within the radius, all points of one
count for all points of the other; only what crosses the circle is split again,
and at the bottom the points of the two blocks are compared by the exact
distance.  So the work for a dense place follows the circles' rims, not the
product of its points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiloqueue.functions import geo, ranked
from kiloqueue.session import materialise, shuffle_partitions

#: points of a block
BLOCK = 64
#: children of a node, as bits of its number
FAN_BITS = 3
#: nodes at which the walk starts
TOP = 64
#: bits of each coordinate in the z-order
Z_BITS = 20
#: boxes nearer than this to the circle's rim (in units of the radius of the earth, 6 mm) count as crossing it
RIM = 1e-9
_AXES = ("x", "y", "z")


def chord(distance_km: float) -> float:
    """The straight distance of two points on the unit sphere that are ``distance_km`` apart on the ground."""
    import math

    return 2 * math.sin(min(distance_km / geo.EARTH_RADIUS_KM, math.pi) / 2)


def _unit(lat: Column, lng: Column) -> dict[str, Column]:
    phi, lam = F.radians(lat), F.radians(lng)
    return {"x": F.cos(phi) * F.cos(lam), "y": F.cos(phi) * F.sin(lam), "z": F.sin(phi)}


def _spread(v: Column) -> Column:
    """Two zero bits after each of the ``Z_BITS`` bits of ``v``."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def z_order(x: Column, y: Column, z: Column) -> Column:
    cell = [F.least(F.floor((c + 1.0) * float(1 << (Z_BITS - 1))), F.lit((1 << Z_BITS) - 1)).cast("long") for c in (x, y, z)]
    return _spread(cell[0]).bitwiseOR(F.shiftleft(_spread(cell[1]), 1)).bitwiseOR(F.shiftleft(_spread(cell[2]), 2))


class Blocks:
    """Points (lat, lng, n and others) in z-order, and the boxes of their nodes."""

    def __init__(self, points: DataFrame, lat: str = "lat", lng: str = "lng", n: str | None = None):
        xyz = points.withColumns(_unit(F.col(lat), F.col(lng))).withColumn("_z", z_order(*map(F.col, _AXES))).withColumn("_all", F.lit(0))
        placed = ranked.row_positions(xyz, "_all", ["_z"])
        block = F.floor((F.col("row_pos") - 1) / BLOCK).cast("long")
        self.points = placed.withColumn("block", block).drop("_z", "_all", "row_pos", "key_rows")
        boxes = [f(c).alias(f"{c}{end}") for c in _AXES for f, end in ((F.min, "0"), (F.max, "1"))]
        self.boxes = materialise(self.points.groupBy("block").agg(*boxes, (F.sum(n) if n else F.count(F.lit(1))).alias("n")), "boxes")
        self.size = self.boxes.count()

    def nodes(self, level: int, prefix: str) -> DataFrame:
        """The nodes of a level: ``<prefix>``, its box and n, the points below it."""
        node = F.shiftright("block", FAN_BITS * level)
        box = [(F.min if end == "0" else F.max)(f"{c}{end}").alias(f"{prefix}{c}{end}") for c in _AXES for end in "01"]
        return self.boxes.groupBy(node.alias(prefix)).agg(*box, F.sum("n").alias(f"{prefix}n"))


def _gaps() -> tuple[Column, Column]:
    """The squares of the least and the largest distance of two boxes."""
    least, most = F.lit(0.0), F.lit(0.0)
    for c in _AXES:
        q0, q1, s0, s1 = (F.col(f"{p}{c}{end}") for p in "qs" for end in "01")
        gap = F.greatest(F.lit(0.0), q0 - s1, s0 - q1)
        span = F.greatest(q1 - s0, s1 - q0)
        least, most = least + gap * gap, most + span * span
    return least, most


def _children(node: str) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit((1 << FAN_BITS) - 1)), lambda k: F.shiftleft(F.col(node), FAN_BITS) + k))


def near_blocks(q: Blocks, s: Blocks, radius_km: float) -> tuple[list[tuple[int, DataFrame]], DataFrame]:
    """Of two trees: the pairs of nodes wholly within the radius, by level, and the pairs of blocks (q, s) that cross it."""
    reach = chord(radius_km)
    least, most = _gaps()
    level = 0
    while max(q.size, s.size) >> FAN_BITS * level > TOP:
        level += 1
    top = (s.size - 1 >> FAN_BITS * level) if s.size else -1  # TOP or fewer nodes, numbered from 0
    start = q.nodes(level, "q").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(top))) if top >= 0 else F.lit(None)).where("s is not null")
    pairs, within = start.withColumn("s", F.col("s").cast("long")).join(s.nodes(level, "s"), "s"), []
    while True:
        judged = materialise(pairs.where(least <= (reach + RIM) ** 2)
                             .select("q", "s", "qn", "sn", (most < max(reach - RIM, 0.0) ** 2).alias("inside")), f"nodes{level}")
        within.append((level, judged.where("inside").select("q", "s", "sn")))
        crossing = judged.where("not inside").select("q", "s")
        if level == 0:
            return within, crossing
        level -= 1
        pairs = (crossing.withColumn("q", _children("q")).join(q.nodes(level, "q"), "q")
                 .withColumn("s", _children("s")).join(s.nodes(level, "s"), "s"))


def counts_within(queries: DataFrame, points: DataFrame, radius_km: float, lat: str = "lat", lng: str = "lng", n: str = "n") -> DataFrame:
    """``queries`` (distinct places) with ``n_near``: the sum of ``n`` over the points strictly nearer than ``radius_km``."""
    q, s = Blocks(queries, lat, lng), Blocks(points, lat, lng, n)
    within, crossing = near_blocks(q, s, radius_km)
    # what whole nodes add is handed down: a node's total is its own and its parent's
    total = None
    for level, pairs in within:
        own = pairs.groupBy("q").agg(F.sum("sn").alias("own"))
        if total is None:
            total = own.select("q", F.col("own").alias("total"))
            continue
        parents = total.withColumn("q", _children("q"))
        total = parents.join(own, "q", "full").select("q", (F.coalesce("total", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("total"))
    places = q.points.select("block", F.col(lat).alias("_qlat"), F.col(lng).alias("_qlng"))
    near = s.points.select(F.col("block").alias("s"), F.col(lat).alias("_slat"), F.col(lng).alias("_slng"), F.col(n).alias("_n"))
    # a stated number of partitions: few bytes are much work here, and would be put into one task
    tasks = max(4 * places.sparkSession.sparkContext.defaultParallelism, shuffle_partitions(places.sparkSession))
    tested = (places.repartition(tasks, "block").join(crossing.withColumnRenamed("q", "block"), "block").join(near, "s")
              .where(geo.haversine_km("_qlat", "_qlng", "_slat", "_slng") < radius_km)
              .groupBy("_qlat", "_qlng").agg(F.sum("_n").alias("_tested")))
    out = places.join(total.select(F.col("q").alias("block"), "total"), "block", "left").join(tested, ["_qlat", "_qlng"], "left")
    return out.select(F.col("_qlat").alias(lat), F.col("_qlng").alias(lng), (F.coalesce("total", F.lit(0)) + F.coalesce("_tested", F.lit(0))).alias("n_near"))


def places_within(left: DataFrame, right: DataFrame, radius_km: float, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Pairs of distinct places (l_lat, l_lng, r_lat, r_lng, distance_km) at most ``radius_km`` apart."""
    a, b = Blocks(left, lat, lng), Blocks(right, lat, lng)
    within, crossing = near_blocks(a, b, radius_km)
    blocks = crossing
    for level, pairs in within:  # down to the blocks of whole nodes
        rows = pairs.select("q", "s")
        for _ in range(level):
            rows = rows.withColumn("q", _children("q")).withColumn("s", _children("s"))
        blocks = blocks.unionByName(rows)
    one = a.points.select(F.col("block").alias("q"), F.col(lat).alias("l_lat"), F.col(lng).alias("l_lng"))
    two = b.points.select(F.col("block").alias("s"), F.col(lat).alias("r_lat"), F.col(lng).alias("r_lng"))
    d = geo.haversine_km("l_lat", "l_lng", "r_lat", "r_lng")
    return one.join(blocks, "q").join(two, "s").drop("q", "s").withColumn("distance_km", d).where(F.col("distance_km") <= radius_km)
