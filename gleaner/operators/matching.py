"""Nearest matches that are refused unless they are strictly under a floor."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..sources.store import spread, stored


def two_nearest(pairs: DataFrame, query: str, distance: str, ordinal: str) -> DataFrame:
    """(query, ordinal, distance, runner_up): the nearest candidate and the next distance; ties go to the smaller ordinal.

    Each pair is read once: Spark limits every task to the first two of a query before it shuffles.
    """
    d = F.col(distance)
    by = Window.partitionBy(query).orderBy(d, F.col(ordinal))
    first = pairs.where(d.isNotNull() & ~F.isnan(d)).withColumn("nr", F.row_number().over(by)).where("nr <= 2")
    one, two = F.col("nr") == 1, F.col("nr") == 2
    return first.groupBy(query).agg(F.max(F.when(one, F.col(ordinal))).alias(ordinal), F.max(F.when(one, d)).alias(distance), F.max(F.when(two, d)).alias("runner_up"))


def best_under(pairs: DataFrame, query: str, distance: str, ordinal: str, floor: float) -> DataFrame:
    """Per query the nearest candidate if its distance is below ``floor``, else no row.

    Adds runner_up (the next distance, above the floor too, or null), margin, and skipped
    (candidates without a distance).
    """
    d = F.col(distance)
    chosen = two_nearest(pairs, query, distance, ordinal).where(d < floor)
    skipped = pairs.where(d.isNull() | F.isnan(d)).groupBy(query).agg(F.count(F.lit(1)).alias("skipped"))
    return _judged(chosen.join(skipped, query, "left").withColumn("skipped", F.coalesce("skipped", F.lit(0)).cast("long")), query, ordinal, distance)


def _judged(chosen: DataFrame, query: str, ordinal: str, distance: str) -> DataFrame:
    return chosen.select(query, ordinal, distance, "runner_up", (F.col("runner_up") - F.col(distance)).alias("margin"), "skipped")


def nearest(pairs: DataFrame, query: str, distance: str, ordinal: str) -> DataFrame:
    """(query, ordinal) of the nearest candidate, however far."""
    d = F.col(distance)
    return pairs.where(d.isNotNull() & ~F.isnan(d)).groupBy(query).agg(F.min_by(ordinal, F.struct(d, F.col(ordinal))).alias(ordinal))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * K.EARTH_RADIUS_M) * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def near_pairs(points: DataFrame, candidates: DataFrame, query: str, ordinal: str, floor_m: float = K.GEO_FLOOR_M, spread_points: bool = False) -> DataFrame:
    """Pairs (query, ordinal, distance) under the floor, by cubes in space.

    Places are points on a sphere; two under the floor differ by less than it in each of x, y and
    z, so they lie in the same cube of that width or in neighbouring ones, at the poles and the date
    line too.  One side goes to its 27 cubes, the other to its own.
    """
    width = floor_m * 1.0001 / K.EARTH_RADIUS_M

    def cubed(rows: DataFrame, name: str, all_around: bool) -> DataFrame:
        lat, lon = F.radians("lat"), F.radians("lon")
        cell = lambda c: F.floor(c / F.lit(width))
        cubes = rows.select(
            name, F.col("lat").alias(f"{name}_lat"), F.col("lon").alias(f"{name}_lon"),
            cell(F.cos(lat) * F.cos(lon)).alias("x"), cell(F.cos(lat) * F.sin(lon)).alias("y"), cell(F.sin(lat)).alias("z"),
        )
        if all_around:
            for axis in "xyz":
                cubes = cubes.withColumn(axis, F.explode(F.array(*(F.col(axis) + i for i in (-1, 0, 1)))))
        return cubes

    pairs = cubed(points, query, spread_points).join(cubed(candidates, ordinal, not spread_points), ["x", "y", "z"])
    distance = haversine_m(*(F.col(f"{n}_{c}") for n in (query, ordinal) for c in ("lat", "lon")))
    return pairs.select(query, ordinal, distance.alias("distance")).where(F.col("distance") < floor_m)


def _placed() -> Column:
    return F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")


#: Grids of cubes, each moved by a part of its width: whatever lies near a place is in one cube with it in some grid.
#: From level to level cubes grow by a factor.
SHIFTS, GROWTH = 2, 2


def _xyz() -> list[Column]:
    lat, lon = F.radians("lat"), F.radians("lon")
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def _in_grids(rows: DataFrame, widths: list[float], *keep: str) -> DataFrame:
    """``rows`` once for each level (a width) and shift, with the cube that holds them; the widest cube of a grid holds all."""
    grids = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(w).alias("w"), F.lit(w * j / SHIFTS).alias("by"), F.lit(j).alias("shift")) for k, w in enumerate(widths) for j in range(SHIFTS)))
    dealt = rows.select(*keep, *(c.alias(n) for c, n in zip(_xyz(), "xyz", strict=True)), F.explode(grids).alias("g"))
    return dealt.select(*keep, "g.level", "g.shift", *(F.floor((F.col(n) + 1 + F.col("g.by")) / F.col("g.w")).alias(n) for n in "xyz"))


def next_nearest(near: DataFrame, points: DataFrame, candidates: DataFrame, query: str, ordinal: str, floor_m: float) -> DataFrame:
    """(query, next): the distance to the nearest candidate besides the one that ``near`` (query, ordinal) has.

    Cubes of growing width are a tree over the places.  The narrowest cube of a query that holds
    two candidates bounds the distance by its diagonal, from counts alone; then only candidates in
    the cubes around the query at the width of that bound are compared.  So each query looks as
    far as the places around it are thin, and no farther.
    """
    widths = [floor_m / K.EARTH_RADIUS_M]
    while widths[-1] < 4:  # moved by up to a width, a cube of four holds the whole sphere
        widths.append(widths[-1] * GROWTH)
    looking = points.join(near.select(query, F.col(ordinal).alias("taken")), query)
    cube = ["level", "shift", "x", "y", "z"]
    full = stored(_in_grids(candidates, widths).groupBy(*cube).agg(F.count(F.lit(1)).alias("held")).where("held > 1").drop("held"), "geo-full")
    level = _in_grids(looking, widths, query).join(full, cube).groupBy(query).agg(F.min("level").alias("level"))
    bounded = stored(looking.join(level, query).select(query, "lat", "lon", "taken", "level"), "geo-bounded")
    used = [r["level"] for r in bounded.select("level").distinct().collect()]  # at most one for each width
    width = lambda: F.lit(math.sqrt(3) * floor_m / K.EARTH_RADIUS_M * 1.0001) * F.pow(F.lit(float(GROWTH)), F.col("level"))  # noqa: E731  the diagonal of a cube
    cell = lambda c, by=0: F.floor(c / width()) + by
    around = bounded.select(query, "taken", "level", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"), *(F.explode(F.array(*(cell(c, i) for i in (-1, 0, 1)))).alias(n) if n == "x" else cell(c).alias(n) for c, n in zip(_xyz(), "xyz", strict=True)))
    for axis in "yz":
        around = around.withColumn(axis, F.explode(F.array(*(F.col(axis) + i for i in (-1, 0, 1)))))
    levels = F.explode(F.array(*map(F.lit, used))) if used else F.explode(F.array().cast("array<int>"))
    dealt = candidates.select(ordinal, "lat", "lon", levels.alias("level")).select(ordinal, "level", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), *(cell(c).alias(n) for c, n in zip(_xyz(), "xyz", strict=True)))
    met = around.join(dealt, ["level", "x", "y", "z"]).where(F.col(ordinal) != F.col("taken"))
    distance = haversine_m(F.col("q_lat"), F.col("q_lon"), F.col("c_lat"), F.col("c_lon"))
    return met.groupBy(query).agg(F.min(distance).alias("next"))


def _at_places(candidates: DataFrame, ordinal: str) -> DataFrame:
    """Of the candidates at one and the same place the two that come first; no other is ever best or next."""
    first = candidates.withColumn("nr", F.row_number().over(Window.partitionBy("lat", "lon").orderBy(ordinal)))
    return first.where("nr <= 2").select(ordinal, "lat", "lon")


def nearest_geo(points: DataFrame, candidates: DataFrame, query: str, ordinal: str, floor_m: float = K.GEO_FLOOR_M) -> DataFrame:
    """The nearest candidate of each point under the floor, with the next one however far.

    Points with one candidate under the floor look for the next one as far as their surroundings
    ask for.  Candidates without a place are ``skipped``.  Rows at one and the same place are
    compared once, so many at few places cost no more than the places; the result is joined back.
    """
    good = stored(_at_places(candidates.where(_placed()), ordinal), "geo-places")
    every = stored(points.where(_placed()).groupBy(query).agg(F.sort_array(F.collect_list(F.struct("lat", "lon"))).alias("at")), "geo-points")
    lead = stored(every.groupBy("at").agg(F.min(query).alias(query)), "geo-leads")
    points = lead.select(query, F.explode("at").alias("p")).select(query, "p.lat", "p.lon")
    near = stored(two_nearest(near_pairs(points, good, query, ordinal, floor_m), query, "distance", ordinal), "geo-near")
    counts = candidates.agg(F.count_if(_placed()).alias("good"), F.count(F.lit(1)).alias("all")).first()
    waiting = near.where("runner_up is null")
    done = near
    if counts["good"] > 1 and not waiting.isEmpty():
        found = next_nearest(waiting.select(query, ordinal), points, good, query, ordinal, floor_m)
        late = waiting.join(found, query, "left").select(query, ordinal, "distance", F.col("next").alias("runner_up"))
        done = near.where("runner_up is not null").union(late)
    skipped = F.lit(counts["all"] - counts["good"]).cast("long").alias("skipped")
    found = lead.join(done, query).drop(query)  # by place, for each point there
    return _judged(every.join(found, "at").select("*", skipped), query, ordinal, "distance")


#: Pairs that a token may make by itself; tokens of more are hot.
HOT_PAIRS = 1 << 22


def shared_tokens(q: DataFrame, c: DataFrame, query: str, ordinal: str) -> DataFrame:
    """(query, ordinal, n_q, n_c, k): how many tokens two sets (name, n, token) share, for pairs that share any."""
    both = q.select(query, F.col("n").alias("n_q"), "token").join(c.select(ordinal, F.col("n").alias("n_c"), "token"), "token")
    return both.groupBy(query, ordinal).agg(F.first("n_q").alias("n_q"), F.first("n_c").alias("n_c"), F.count(F.lit(1)).alias("k"))


def _with_hot(q: DataFrame, c: DataFrame, hot: DataFrame, counted: DataFrame, query: str, ordinal: str) -> DataFrame:
    """``counted`` (over all but hot tokens) with what hot tokens add, for pairs that can be among the two best of a query.

    With h the hot tokens of a set, a pair shares at least k tokens and at most k + min(h_q, h_c).
    A pair whose most is below its query's second least is neither best nor next.  Pairs that share
    hot tokens only share at most the hottest set's part; queries for which that reaches their
    second least count all tokens.
    """
    split = lambda rows, name: stored(rows.join(hot, "token").groupBy(name, "n").agg(F.collect_set("token").alias("hot")), "label-hot")
    hot_q, hot_c = split(q, query), split(c, ordinal)
    part = F.max(F.size("hot") / F.col("n")).alias("part")
    hottest = hot_c.agg(part).first()["part"] or 0.0
    least = F.least("n_q", "n_c")
    held = counted.withColumn("low", F.col("k") / least)
    second = held.withColumn("nr", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("low"), ordinal))).where("nr <= 2")
    bound = second.groupBy(query).agg(F.max(F.when(F.col("nr") == 2, F.col("low"))).alias("bound"))
    state = stored(
        hot_q.select(query, (F.size("hot") / F.col("n")).alias("own")).join(bound, query, "left").select(query, (F.greatest("own", F.lit(hottest)) >= F.coalesce("bound", F.lit(0.0))).alias("open")),
        "label-open",
    )
    opened = state.where("open").select(query)
    whole = shared_tokens(q.join(opened, query, "left_semi"), c, query, ordinal)
    bounded = held.join(opened, query, "left_anti").join(bound, query, "left")
    hot_of = lambda rows, name, as_name: rows.select(name, F.col("hot").alias(as_name))
    none = F.array().cast("array<string>")
    near = bounded.join(hot_of(hot_q, query, "a"), query, "left").join(hot_of(hot_c, ordinal, "b"), ordinal, "left")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    most = (F.col("k") + F.least(F.size(a), F.size(b))) / least
    close = near.where(most >= F.coalesce("bound", F.lit(0.0)))
    return whole.union(close.select(query, ordinal, "n_q", "n_c", F.col("k") + F.size(F.array_intersect(a, b))))


def label_pairs(q: DataFrame, c: DataFrame, query: str, ordinal: str) -> DataFrame:
    """(query, ordinal, distance = 1 - overlap) of token sets (name, n, token); of each query at least the two nearest that share a token.

    Pairs are counted token by token.  Tokens that would make too many pairs by themselves are left
    out of that and met by bounds.
    """
    count = lambda rows, name: rows.groupBy("token").agg(F.count(F.lit(1)).alias(name))
    hot = stored(count(q, "held_q").join(count(c, "held_c"), "token").where(F.col("held_q") * F.col("held_c") > HOT_PAIRS).select("token"), "label-hot-tokens")
    if hot.isEmpty():
        pairs = shared_tokens(q, c, query, ordinal)
    else:
        usual = lambda rows: rows.join(hot, "token", "left_anti")
        counted = stored(shared_tokens(usual(q), usual(c), query, ordinal), "label-counts")
        pairs = _with_hot(q, c, hot, counted, query, ordinal)
    return pairs.select(query, ordinal, (1 - F.col("k") / F.least("n_q", "n_c")).alias("distance"))


def best_label(queries: DataFrame, candidates: DataFrame, query: str, text: str, ordinal: str, label: str, floor: float = K.OVERLAP_FLOOR) -> DataFrame:
    """The candidate whose label shares most tokens with a query's text, if the overlap is above ``floor``.

    The runner-up is the next of all candidates; one that shares nothing has distance 1.
    """

    def sets(rows: DataFrame, name: str, c: str) -> DataFrame:
        held = spread(rows.select(name, c)).select(name, T.tokens(c).alias("t"))
        return stored(held.select(name, F.size("t").alias("n"), F.explode("t").alias("token")), "label-tokens")  # counted and joined, so found once

    several = len(candidates.select(ordinal).take(2)) > 1
    pairs = label_pairs(sets(queries, query, text), sets(candidates, ordinal, label), query, ordinal)
    near = two_nearest(pairs, query, "distance", ordinal).where(F.col("distance") < 1 - floor)
    last = F.lit(1.0 if several else None).cast("double")
    return _judged(near.withColumn("runner_up", F.coalesce("runner_up", last)).withColumn("skipped", F.lit(0).cast("long")), query, ordinal, "distance")


def top_by(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)
