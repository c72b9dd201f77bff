"""Station ranking (R-A..R-H, J-03, J-06, J-07, J-14, O-02, W-06).

The reference scores one user at a time in a Python loop.  Here a ``users``
table is ranked against all stations at once: groups of like users are pruned
against stations by score bounds (J-07), then latest prediction per station
(J-03), native score expressions (R-B, R-C) and a per-user ``row_number`` top-N
(W-06), which Spark plans with a partial window-group limit before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiloqueue.functions import geo, spatial
from kiloqueue.functions.scalars import action_label, routing_url
from kiloqueue.operators.predict import predict_table
from kiloqueue.session import materialise, shuffle_partitions

# Preference weights per priority (wait, distance, availability,
# reliability, traffic), normalisers, bonuses.
PRIORITY_WEIGHTS = {
    "balanced": (0.35, 0.25, 0.20, 0.10, 0.10),
    "speed": (0.50, 0.20, 0.15, 0.10, 0.05),
    "distance": (0.20, 0.50, 0.15, 0.10, 0.05),
    "availability": (0.20, 0.15, 0.50, 0.10, 0.05),
}
MAX_WAIT_NORMALISE = 60.0
MAX_DIST_NORMALISE = 20.0
CONNECTOR_BONUS = 0.05
POWER_BONUS = 0.02
FAST_CHARGER_KW = 150.0
DEFAULT_WAIT = 20.0
#: degrees of the cells in which users are pruned together, large first
CELL_DEGREES = {"large": 0.04, "small": 0.01}
#: stations of a part of a grid cell, in which they meet the classes of users
CELL_STATIONS = 500
#: rows of a group that are folded as one array
FOLD_ROWS = 1000
#: parts that a dense cell's rows are dealt over
SALTS = 8
WEIGHT_COLUMNS = ["w_wait", "w_distance", "w_availability", "w_reliability", "w_traffic"]


def with_weights(users: DataFrame) -> DataFrame:
    """Attach weights by priority.  The weight table is a fixed 4-row literal, so
    the lookup is a CASE expression (no join needed)."""
    def pick(i):
        expr = None
        for p, w in PRIORITY_WEIGHTS.items():
            cond = F.col("priority") == p
            expr = F.when(cond, F.lit(w[i])) if expr is None else expr.when(cond, F.lit(w[i]))
        return expr.otherwise(F.lit(PRIORITY_WEIGHTS["balanced"][i]))

    return users.withColumns({c: pick(i) for i, c in enumerate(WEIGHT_COLUMNS)})


def latest_predictions(predictions: DataFrame, order_col: str = "seq") -> DataFrame:
    """J-03: one prediction per station, the last one (largest ``order_col``) wins."""
    return predictions.groupBy("station_id").agg(
        F.max_by("predicted_wait_min", order_col).alias("predicted_wait_min"))


def attach_wait(stations: DataFrame, predictions: DataFrame | None) -> DataFrame:
    """Wait used for scoring: prediction if the station has one, else its own
    ``wait_time_minutes``, else 20."""
    own = F.col("wait_time_minutes") if "wait_time_minutes" in stations.columns else F.lit(None)
    if predictions is None:
        return stations.withColumn("_wait", F.coalesce(own, F.lit(DEFAULT_WAIT)).cast("double"))
    pred = latest_predictions(predictions).withColumnRenamed("predicted_wait_min", "_pred")
    out = stations.join(pred, "station_id", "left")
    return out.withColumn("_wait", F.when(F.col("_pred").isNotNull(), F.col("_pred"))
                          .otherwise(F.coalesce(own, F.lit(DEFAULT_WAIT))).cast("double")).drop("_pred")


def score_record(rank_col: str | None = "rank", distance: Column | None = None) -> list[Column]:
    """StationScore.to_dict() as columns (plain-text action label)."""
    dist = distance if distance is not None else F.round("distance_km", 2)
    cols = [] if rank_col is None else [F.col(rank_col).cast("int").alias("rank")]
    return cols + [
        "station_id",
        F.coalesce(F.col("name").cast("string"), F.lit("Unknown Station")).alias("name"),
        "lat", "lng",
        dist.alias("distance_km"),
        F.round("_wait", 1).alias("predicted_wait_min"),
        F.col("_avail").alias("available_ports"),
        F.col("_total").alias("total_ports"),
        F.round((F.lit(1.0) - F.col("_s_avail")) * 100.0, 1).alias("utilization_pct"),
        F.coalesce(F.col("connector_type").cast("string"), F.lit("Unknown")).alias("connector_type"),
        F.col("_power").alias("power_kw"),
        F.coalesce(F.col("operator").cast("string"), F.lit("")).alias("operator"),
        F.col("_status").alias("status"),
        F.round("_traffic", 3).alias("traffic_score"),
        F.round("composite", 4).alias("composite_score"),
        F.struct(F.round("_s_wait", 4).alias("wait_score"), F.round("_s_dist", 4).alias("distance_score"),
                 F.round("_s_avail", 4).alias("availability_score"),
                 F.round("_s_rel", 4).alias("reliability_score"),
                 F.round("_s_traffic", 4).alias("traffic_score")).alias("score_breakdown"),
        routing_url(F.col("lat"), F.col("lng")).alias("routing_url"),
        action_label(F.col("_wait"), F.col("_avail")).alias("action"),
    ]


def station_scores(stations: DataFrame) -> DataFrame:
    """Station-level parts of R-B (independent of the user): computed once per
    station instead of once per (user, station) pair."""
    avail = F.coalesce(F.col("available_ports"), F.lit(1))
    total = F.coalesce(F.col("num_ports"), F.greatest(avail, F.lit(1)))
    traffic = F.coalesce(F.col("traffic_score"), F.lit(0.3))
    status = F.coalesce(F.col("status").cast("string"), F.lit("Unknown"))
    return stations.withColumns({
        "_s_wait": F.greatest(F.lit(0.0), F.lit(1.0) - F.col("_wait") / MAX_WAIT_NORMALISE),
        "_s_avail": avail / F.greatest(total, F.lit(1)),
        "_s_rel": F.when(status.contains("Operational") | status.contains("Online"), 1.0).otherwise(0.3),
        "_s_traffic": F.greatest(F.lit(0.0), F.lit(1.0) - traffic),
        "_avail": avail, "_total": total, "_traffic": traffic, "_status": status,
        "_power": F.coalesce(F.nullif(F.col("power_kw"), F.lit(0.0)), F.lit(50.0)),
        "_conn_l": F.lower(F.coalesce(F.col("connector_type").cast("string"), F.lit(""))),
    })


def pair_composite(dist: Column, connector_pref: Column) -> Column:
    """R-C on a (user, station) pair, from the station parts and the user's weights."""
    s_dist = F.greatest(F.lit(0.0), F.lit(1.0) - dist / MAX_DIST_NORMALISE)
    comp = (F.col("w_wait") * F.col("_s_wait") + F.col("w_distance") * s_dist
            + F.col("w_availability") * F.col("_s_avail") + F.col("w_reliability") * F.col("_s_rel")
            + F.col("w_traffic") * F.col("_s_traffic"))
    match = connector_pref.isNotNull() & (connector_pref != "") & F.col("_conn_l").contains(F.lower(connector_pref))
    comp = F.when(match, F.least(F.lit(1.0), comp + CONNECTOR_BONUS)).otherwise(comp)
    return F.when(F.col("_power") >= FAST_CHARGER_KW, F.least(F.lit(1.0), comp + POWER_BONUS)).otherwise(comp)


def _cells(users: DataFrame, level: str) -> DataFrame:
    """Users with the centre of their cell (``lat_<level>``, ``lng_<level>``)."""
    size = CELL_DEGREES[level]
    centre = lambda c: (F.floor(F.col(c) / size) + 0.5) * size
    return users.withColumns({f"lat_{level}": centre("user_lat"), f"lng_{level}": centre("user_lng")})


def _survivors(pairs: DataFrame, keys: list[str], slack: float, top_n: int) -> DataFrame:
    """Of (class, station) pairs with the distance ``_d`` to the class's centre, those that can be in some user's top.

    No user of a class is farther than ``slack`` from its centre, so a station's score for any of
    them lies between two bounds.  A station goes if its upper bound is below the ``top_n``-th
    best lower bound of the stations that all users of the class can reach.
    """
    upper = pair_composite(F.greatest(F.col("_d") - slack, F.lit(0.0)), F.col("pref"))
    lower = F.when(F.col("_d") + slack <= F.col("least_detour"), pair_composite(F.col("_d") + slack, F.col("pref")))
    bounded = pairs.where(F.col("_d") - slack <= F.col("most_detour")).withColumns({"_upper": upper, "_lower": lower})
    best_first = Window.partitionBy(*keys).orderBy(F.col("_lower").desc())
    # a row number with a limit keeps the best few of a class in every task, before the shuffle and after it
    best = bounded.where(F.col("_lower").isNotNull()).select(*keys, "_lower").withColumn("_rn", F.row_number().over(best_first)).where(F.col("_rn") <= top_n)
    nth = best.groupBy(*keys).agg(F.min("_lower").alias("_nth"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") == top_n).drop("_k")
    return (bounded.join(nth, keys, "left")
            .where(F.col("_nth").isNull() | (F.col("_upper") >= F.col("_nth") - 1e-9)).drop("_upper", "_lower", "_nth", "_d"))


def _meet(classes: DataFrame, stations: DataFrame, at: list[str]) -> DataFrame:
    """The join of classes and stations on their cell, a part of a cell's stations at a time.

    The grid has few cells where detours are long, and a few MB of stations make many pairs: cells are cut into
    parts of about ``CELL_STATIONS``, and the parts are dealt to a number of tasks that is not made smaller for small inputs.
    """
    n = shuffle_partitions(stations.sparkSession)
    sizes = stations.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / CELL_STATIONS).cast("int").alias("_parts"))
    dealt = stations.join(sizes, at).withColumn("_part", F.pmod(F.xxhash64("station_id", "lat", "lng"), F.col("_parts")).cast("int")).drop("_parts")
    spread = classes.join(sizes, at).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    keys = [*at, "_part"]
    return spread.repartition(n, *keys).join(dealt.repartition(n, *keys), keys).drop("_part")


def candidate_pairs(users: DataFrame, stations: DataFrame, top_n: int) -> DataFrame:
    """The (user, station) pairs that can be in a user's top: users by cell, priority, connector and detour band
    are pruned against stations first in large cells, then in small ones.

    A band holds detours up to a power of two, so a long detour widens the search of its own band alone.
    """
    band = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("max_detour_km"), F.lit(1e-3))))).cast("int")
    priority = F.when(F.col("priority").isin(list(PRIORITY_WEIGHTS)), F.col("priority")).otherwise("balanced")
    u = users.select("user_id", "user_lat", "user_lng", "max_detour_km", band.alias("band"), priority.alias("priority"),
                     F.lower(F.coalesce("connector_pref", F.lit(""))).alias("pref"))
    coarse, fine = CELL_DEGREES
    u = _cells(_cells(u, coarse), fine)
    kind = ["band", "priority", "pref"]
    coarse_keys, fine_keys = [*kind, f"lat_{coarse}", f"lng_{coarse}"], [*kind, f"lat_{fine}", f"lng_{fine}"]
    detours = [F.min("max_detour_km").alias("least_detour"), F.max("max_detour_km").alias("most_detour")]
    slack = {k: geo.EARTH_RADIUS_KM * math.radians(s) + 1e-6 for k, s in CELL_DEGREES.items()}  # half a cell north plus half a cell east
    distance = lambda s: geo.haversine_km(F.col(f"lat_{s}"), F.col(f"lng_{s}"), F.col("lat"), F.col("lng"))

    bands = [r["band"] for r in u.select("band").distinct().collect()] or [0]  # powers of two of kilometres: a few
    radius = F.pow(F.lit(2.0), F.col("band")) + slack[coarse]
    st = materialise(stations.withColumn("band", F.explode(F.array(*map(F.lit, bands))))
                     .withColumn("_cell", geo.own_cell("lat", "lng", radius)), "stations")
    large = with_weights(u.groupBy(*coarse_keys).agg(*detours)) \
        .withColumn("_cell", F.explode(geo.neighbour_cells(F.col(f"lat_{coarse}"), F.col(f"lng_{coarse}"), radius)))
    first = _survivors(_meet(large, st, ["band", "_cell"]).withColumn("_d", distance(coarse)).drop("_cell"),
                       coarse_keys, slack[coarse], top_n).drop("least_detour", "most_detour")
    small = u.groupBy(*fine_keys, *coarse_keys[3:]).agg(*detours)
    second = _survivors(small.join(first, coarse_keys).withColumn("_d", distance(fine)), fine_keys, slack[fine], top_n)
    near = second.drop(*coarse_keys[3:], "least_detour", "most_detour")
    return u.drop(*coarse_keys[3:]).join(near, fine_keys)


def recommend(users: DataFrame, stations: DataFrame, predictions: DataFrame | None = None,
              top_n: int = 5) -> DataFrame:
    """R-D for every user: detour filter (P-17), scores, top-N per user (O-02/W-06).

    ``users``: user_id, user_lat, user_lng, priority, connector_pref, max_detour_km.
    Exact, without all user x station pairs (``candidate_pairs``).  Pair rows
    carry only (user, station, distance, composite) through the top-N sort;
    station details are joined back for the winners only.
    """
    u = users if "connector_pref" in users.columns else users.withColumn("connector_pref", F.lit(None).cast("string"))
    st = station_scores(attach_wait(stations, predictions))
    slim = st.select("station_id", "lat", "lng", "_s_wait", "_s_avail", "_s_rel", "_s_traffic", "_power", "_conn_l") \
        .where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    pairs = candidate_pairs(u, slim, top_n).withColumn(
        "distance_km", geo.haversine_km(F.col("user_lat"), F.col("user_lng"), F.col("lat"), F.col("lng")))
    pairs = pairs.where(F.col("distance_km") <= F.col("max_detour_km"))
    scored = pairs.select("user_id", "station_id", "distance_km",
                          pair_composite(F.col("distance_km"), F.col("pref")).alias("composite"))
    w = Window.partitionBy("user_id").orderBy(F.col("composite").desc(), F.col("station_id").asc())
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    full = top.join(st, "station_id")
    full = full.withColumn("_s_dist", F.greatest(F.lit(0.0), F.lit(1.0) - F.col("distance_km") / MAX_DIST_NORMALISE))
    return full.select("user_id", *score_record())


def recommend_future(users: DataFrame, stations: DataFrame, target_hour: int, top_n: int = 5,
                     model_pred: str | None = None) -> DataFrame:
    """R-F: ranks by the wait predicted for ``target_hour`` with an empty queue and traffic .4.

    ``model_pred`` names a station column with a fitted model's prediction for that hour; the
    queue model alone does not depend on the hour.
    """
    ask = stations.withColumns({"queue_size": F.lit(0), "hour": F.lit(target_hour), "traffic_score": F.lit(0.4)})
    answer = predict_table(ask, model_pred).select("station_id", F.col("predicted_wait_min").alias("wait_time_minutes"))
    return recommend(users, stations.drop("wait_time_minutes").join(answer, "station_id"), None, top_n)


def recommend_en_route(routes: DataFrame, stations: DataFrame, max_detour_km: float = 5.0,
                       top_n: int = 3, priority: str = "balanced", connector_pref: str | None = None) -> DataFrame:
    """R-E (J-06): stations whose nearest waypoint is within ``max_detour_km``;
    scored from the route's first waypoint; reported distance = nearest, 2 decimals.

    ``routes``: route_id, wp_idx, wp_lat, wp_lng (one row per waypoint).
    """
    st = station_scores(attach_wait(stations, None))
    # places are paired once, however many routes or stations share them
    places = [t.select(F.col(a).alias("lat"), F.col(b).alias("lng")).where("lat is not null and lng is not null").distinct()
              for t, a, b in ((routes, "wp_lat", "wp_lng"), (st, "lat", "lng"))]
    pairs = spatial.places_within(*places, max_detour_km)
    at = (routes.join(pairs, (F.col("wp_lat") == F.col("l_lat")) & (F.col("wp_lng") == F.col("l_lng")))
          .groupBy("route_id", "r_lat", "r_lng").agg(F.min("distance_km").alias("_min_d")))
    near = at.join(st.select("station_id", "lat", "lng"), (F.col("r_lat") == F.col("lat")) & (F.col("r_lng") == F.col("lng"))) \
        .select("route_id", "station_id", "_min_d")
    first = (routes.groupBy("route_id")
             .agg(F.min_by(F.struct("wp_lat", "wp_lng"), "wp_idx").alias("_wp0"))
             .select("route_id", F.col("_wp0.wp_lat").alias("_lat0"), F.col("_wp0.wp_lng").alias("_lng0")))
    cand = near.join(first, "route_id").join(st, "station_id")
    cand = with_weights(cand.withColumn("priority", F.lit(priority)))
    dist0 = geo.haversine_km(F.col("_lat0"), F.col("_lng0"), F.col("lat"), F.col("lng"))
    pref = F.lit(connector_pref).cast("string")
    scored = cand.withColumns({"distance_km": dist0, "composite": pair_composite(dist0, pref),
                               "_s_dist": F.greatest(F.lit(0.0), F.lit(1.0) - dist0 / MAX_DIST_NORMALISE)})
    w = Window.partitionBy("route_id").orderBy(F.col("composite").desc(), F.col("station_id").asc())
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return ranked.select("route_id", *score_record(distance=F.round("_min_d", 2)))


def apply_saved_preferences(requests: DataFrame, saved: DataFrame) -> DataFrame:
    """R-G: a user's saved preferences replace the request's fields."""
    sv = saved.select("user_id", *[F.col(c).alias(f"_sv_{c}") for c in ("priority", "connector_pref",
                                                                         "max_detour_km")])
    out = requests.join(sv, "user_id", "left")
    has = F.col("_sv_priority").isNotNull()
    return out.withColumns({
        c: F.when(has, F.col(f"_sv_{c}")).otherwise(F.col(c)) for c in ("priority", "connector_pref",
                                                                          "max_detour_km")
    }).drop(*[f"_sv_{c}" for c in ("priority", "connector_pref", "max_detour_km")])


def diversify(recs: DataFrame, min_distance_km: float = 1.0, group_col: str = "user_id", order_col: str = "rank",
              largest: int | None = None) -> DataFrame:
    """R-H / J-14: walk each group's results in order, drop any result closer
    (planar km) than ``min_distance_km`` to an already kept one.

    Groups of at most ``FOLD_ROWS`` rows are folded as arrays; ``largest`` states a bound that the caller
    knows (a top-N), otherwise the groups are counted.  Larger groups are decided in rounds over a grid.
    """
    if largest is None:
        recs = materialise(recs, "recs")
        largest = recs.groupBy(group_col).count().agg(F.max("count")).first()[0] or 0
    if largest <= FOLD_ROWS:
        return _walk(recs, min_distance_km, group_col, order_col)
    return _keep_in_rounds(recs, min_distance_km, group_col, order_col)


def _in_order(recs: DataFrame, group_col: str, order_col: str) -> Column:
    """A row's place in its group's walk, and all of the row."""
    return F.struct(F.col(order_col).alias("_o"), *[c for c in recs.columns if c != group_col])


def _walk(recs: DataFrame, min_distance_km: float, group_col: str, order_col: str) -> DataFrame:
    """The walk as a fold over each group's array, for groups of a bounded size."""
    arr = F.array_sort(F.collect_list(_in_order(recs, group_col, order_col)))

    def step(acc, x):
        too_close = F.exists(acc, lambda k: geo.planar_km(x["lat"], x["lng"], k["lat"], k["lng"]) < min_distance_km)
        return F.when(too_close, acc).otherwise(F.concat(acc, F.array(x)))

    grouped = recs.groupBy(group_col).agg(arr.alias("_items"))
    folded = grouped.select(group_col, F.aggregate(
        "_items", F.slice(F.col("_items"), 1, 0), step).alias("_kept"))
    return folded.select(group_col, F.inline("_kept")).drop("_o")


def _keep_in_rounds(recs: DataFrame, min_distance_km: float, group_col: str, order_col: str) -> DataFrame:
    """The walk's result for groups of any size: the first maximal independent set, in rounds.

    Cells are so small that two rows of one are always too close, so a cell keeps one row at most.  A cell's
    first open row is kept if it also comes before the first open rows of the 24 cells around it: then nothing
    that could drop it is left.  Each round keeps all such rows and drops what is too close to them; when what
    is open fits the fold, the walk ends it.  Rows without a place are near nothing and stay.
    """
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    if min_distance_km <= 0:
        return recs
    side = min_distance_km / geo.KM_PER_DEGREE / math.sqrt(2) * (1 - 1e-9)
    near, salt = [-2, -1, 0, 1, 2], F.pmod(F.xxhash64(*recs.columns), F.lit(SALTS)).cast("int")
    cell = {c: F.floor(F.col(a) / side).cast("long") for c, a in (("_cx", "lat"), ("_cy", "lng"))}
    around = F.explode(F.array(*[F.struct((F.col("_cx") + dx).alias("_cx"), (F.col("_cy") + dy).alias("_cy")) for dx in near for dy in near]))
    at = [group_col, "_cx", "_cy"]
    rows = _in_order(recs, group_col, order_col)
    left = materialise(recs.where(placed).select(group_col, rows.alias("_r"), salt.alias("_salt"), *[e.alias(c) for c, e in cell.items()]), "open")
    kept = [recs.where(~placed)]
    while True:
        largest = left.groupBy(group_col).count().agg(F.max("count")).first()[0] or 0
        if largest <= FOLD_ROWS:
            break
        firsts = left.groupBy(*at).agg(F.min("_r").alias("_r"))
        seen = firsts.select(group_col, "_r", around.alias("_c")).groupBy(group_col, "_c._cx", "_c._cy").agg(F.min("_r").alias("_least"))
        won = materialise(firsts.join(seen, at).where(F.col("_r") == F.col("_least")).select(*at, "_r"), "kept")
        kept.append(won.select(group_col, "_r.*").drop("_o"))
        shadow = (won.select(group_col, "_r.lat", "_r.lng", around.alias("_c")).groupBy(group_col, "_c._cx", "_c._cy")
                  .agg(F.collect_list(F.struct("lat", "lng")).alias("_by"))  # kept rows are apart: a few a cell
                  .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        close = F.exists("_by", lambda k: geo.planar_km(F.col("_r.lat"), F.col("_r.lng"), k["lat"], k["lng"]) < min_distance_km)
        left = materialise(left.join(shadow, [*at, "_salt"], "left").where(~F.coalesce(close, F.lit(False))).select(*left.columns), "open")
    kept.append(_walk(left.select(group_col, "_r.*").drop("_o"), min_distance_km, group_col, order_col))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more.select(*recs.columns))
    return out
