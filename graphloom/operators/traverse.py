"""Reverse impact, closures and paths, as joins of a frontier with the edges, level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..graph import Graph
from ..storage import stored


def hops(g: Graph, kinds: list[str] | None = None, min_confidence: str = "possible") -> DataFrame:
    """The distinct relations that a traversal follows, each at its best confidence; parallel occurrences lead nowhere new."""
    return g.following(S.kinds_of(kinds, S.IMPACT_KINDS), min_confidence).groupBy("source_id", "target_id").agg(F.max(F.struct("rank", "kind")).alias("best")).select("source_id", "target_id", F.col("best.rank").alias("rank"), F.col("best.kind").alias("via_kind"))


#: A frontier up to which it is sent to the edges; larger ones meet the edges as they are so many times, and then the distinct relations, which are written for it.
FEW_FRONTIER, PLAIN = 100_000, 2


def _users(g: Graph, kinds: list[str] | None, min_confidence: str) -> Callable[[DataFrame, int], DataFrame]:
    """What uses a frontier (``seed, id, rank``) of so many rows: ``seed, id, rank, via``, where parallel occurrences may repeat."""
    plain, large = g.following(S.kinds_of(kinds, S.IMPACT_KINDS), min_confidence), []

    def step(frontier: DataFrame, n: int) -> DataFrame:
        tips = frontier.select("seed", F.col("id").alias("target_id"), F.col("rank").alias("so_far"))
        edges = large[-1] if len(large) > PLAIN else plain
        if n <= FEW_FRONTIER:
            tips = F.broadcast(tips)
        elif len(large) <= PLAIN:
            large.append(plain if len(large) < PLAIN else stored(hops(g, kinds, min_confidence), "hops"))
            edges = large[-1]
        return tips.join(edges, "target_id").select("seed", F.col("source_id").alias("id"), F.least("rank", "so_far").alias("rank"), F.col("target_id").alias("via"))

    return step


def impact(g: Graph, seeds: DataFrame, max_depth: int = 4, kinds: list[str] | None = None, min_confidence: str = "possible") -> DataFrame:
    """Everything that depends on the seeds: ``seed, id, distance, rank, via``.

    ``seeds`` has ``id``.  Distance is the breadth-first level.  ``rank`` is the best over all shortest
    paths of the least confidence along the path; ``via`` is the dependency reached, by best rank and then id.
    Each level joins only what the last one found, leaves out what is known, and is written, so that the plan stays as
    long as one level; the walk ends when a level finds nothing.
    """
    S.between("max_depth", max_depth, 1, 8)
    users = _users(g, kinds, min_confidence)
    known = stored(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("distance"), F.lit(3).alias("rank"), F.lit(None).cast("string").alias("via")), "level")
    frontier, n = known, known.count()
    for depth in range(1, max_depth + 1):
        step = users(frontier, n)
        best = step.groupBy("seed", "id").agg(F.max("rank").alias("rank"), F.min_by("via", F.struct(-F.col("rank"), F.col("via"))).alias("via"))
        frontier = stored(best.join(known.select("seed", "id"), ["seed", "id"], "left_anti").select("seed", "id", F.lit(depth).alias("distance"), "rank", "via"), "level")
        if not (n := frontier.count()):
            break
        known = known.unionByName(frontier)
    return known.where("distance > 0")


def nearest(found: DataFrame) -> DataFrame:
    """Over several seeds, each dependant at its smallest distance; the first seed wins a tie."""
    order = Window.partitionBy("id").orderBy("distance", "seed")
    return found.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def nearest_impact(g: Graph, seeds: DataFrame, max_depth: int = 4, kinds: list[str] | None = None, min_confidence: str = "possible", labels: int = 2) -> DataFrame:
    """What ``nearest(impact(...))`` gives, without a row for each seed and component: ``id, seed, distance, rank, via``.

    All seeds go at once, and a component keeps its ``labels`` nearest seeds, by distance and then id.  One label
    is enough for components that aren't seeds: whatever lies on a shortest way from a component's nearest
    seed has that seed as its own nearest.  A seed is nearest to itself, so what depends on which other seed takes
    a second label; where seeds among the dependants don't matter, ``labels=1`` leaves them out.
    """
    S.between("max_depth", max_depth, 1, 8)
    S.between("labels", labels, 1, 2)
    users = _users(g, kinds, min_confidence)
    known = stored(seeds.select("id").distinct().select("id", F.col("id").alias("seed"), F.lit(0).alias("distance"), F.lit(3).alias("rank"), F.lit(None).cast("string").alias("via")), "labels")
    frontier, n = known, known.count()
    for depth in range(1, max_depth + 1):
        step = users(frontier, n)
        best = step.groupBy("id", "seed").agg(F.max("rank").alias("rank"), F.min_by("via", F.struct(-F.col("rank"), F.col("via"))).alias("via"))
        # No more seeds than labels are held.
        held = known.groupBy("id").agg(F.collect_set("seed").alias("held"))
        fresh = best.join(held, "id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>"))).where((F.size("held") < labels) & ~F.array_contains("held", F.col("seed")))
        first = fresh.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("seed"))).where(F.col("k") <= labels).where(F.col("k") <= labels - F.size("held"))
        frontier = stored(first.select("id", "seed", F.lit(depth).alias("distance"), "rank", "via"), "labels")
        if not (n := frontier.count()):
            break
        known = known.unionByName(frontier)
    label = F.struct("distance", "seed", "rank", "via")
    return known.where("distance > 0").groupBy("id").agg(F.min(label).alias("label")).select("id", "label.seed", "label.distance", "label.rank", "label.via")


def entry_points(g: Graph, found: DataFrame, roles: list[str]) -> DataFrame:
    """Dependants that start something: routes and commands, or nodes of an entry role."""
    by_role = g.classifications.where(F.col("role").isin(roles)).select(F.col("node_id").alias("id")).distinct().withColumn("r", F.lit(True))
    return found.join(g.nodes.select("id", "kind"), "id").join(by_role, "id", "left").where(F.col("kind").isin(S.ENTRY_KINDS) | F.coalesce("r", F.lit(False))).drop("r")


def closure(edges: DataFrame, max_depth: int = 20, start: DataFrame | None = None) -> DataFrame:
    """Ancestors by ``child, parent``: ``child, ancestor, depth`` with the least depth; ends when a round finds nothing.

    ``start``: the children asked about, all by default.
    """
    step = stored(edges.select("child", "parent").where("child <> parent").distinct(), "steps")
    first = step if start is None else step.join(start.select("child").distinct(), "child", "left_semi")
    known = first.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    frontier = known
    for depth in range(2, max_depth + 1):
        more = frontier.select("child", F.col("ancestor").alias("mid")).join(step.select(F.col("child").alias("mid"), "parent"), "mid").select("child", F.col("parent").alias("ancestor")).where("child <> ancestor").distinct()
        frontier = stored(more.join(known, ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "ancestors")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def endpoints(g: Graph, ids: DataFrame) -> DataFrame:
    """A class or interface stands also for all that it contains."""
    big = g.nodes.join(ids.select("id"), "id", "left_semi").where(F.col("kind").isin("class", "interface")).select(F.col("id").alias("source_id"))
    members = g.edges.where("kind = 'contains'").join(big, "source_id", "left_semi").select(F.col("target_id").alias("id"))
    return ids.select("id").unionByName(members).distinct()


def _away(steps: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """How many hops each component is from a goal, up to ``most``: ``next, left``."""
    away = level = stored(goals.select(F.col("id").alias("next"), F.lit(0).alias("left")), "distances")
    for distance in range(1, most + 1):
        level = stored(steps.join(level.select("next"), "next", "left_semi").select(F.col("tip").alias("next")).distinct().join(away, "next", "left_anti").select("next", F.lit(distance).alias("left")), "distances")
        if level.isEmpty():
            break
        away = away.unionByName(level)
    return away


def _up_to(steps: DataFrame, away: DataFrame, starts: DataFrame, most: int, count: Callable[[int, int], bool]) -> DataFrame | None:
    """Simple paths of ``most`` hops at most, each up to the first goal that it meets; only what can still reach one in the hops left is followed.

    ``count`` takes each level's states; None if it gives False.
    """
    states = starts.select(F.array("id").alias("path"), F.col("id").alias("tip"), F.lit(3).alias("rank"), F.lit(0).alias("semantic"))
    out = None
    for depth in range(1, most + 1):
        moved = states.join(steps, "tip").join(away, "next").where(F.col("left") <= most - depth).withColumn("done", F.col("left") == 0)
        # A path may end where it began.
        moved = moved.where(F.col("done") | ~F.array_contains("path", F.col("next"))).select(F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("tip"), F.least("rank", "r").alias("rank"), (F.col("semantic") + F.col("s")).alias("semantic"), "done")
        moved = stored(moved, "paths")
        n = moved.count()
        if not count(n, depth):
            return None
        hits = moved.where("done").select(F.array_join("path", ">").alias("signature"), F.lit(depth).alias("hops"), "rank", "semantic")
        out = hits if out is None else out.unionByName(hits)
        if not n:
            break
        states = moved.where("not done").drop("done")
    return out


#: States up to which all paths are listed in one go; beyond it the best are looked for first, with equal results.
FEW_STATES = 100_000


def paths(g: Graph, start: DataFrame, goal: DataFrame, max_depth: int = 6, max_paths: int = 5, kinds: list[str] | None = None, min_confidence: str = "possible", most_states: int | None = None, few_states: int = FEW_STATES, followed: list[int] | None = None) -> DataFrame:
    """The best simple paths from ``start`` to ``goal`` (``id`` each), ranked: ``signature, hops, rank, semantic``.

    Order: best least confidence, fewer hops, more semantic edges, signature.  Of parallel edges the best counts.  Distances to
    the goal, found backward first, keep out what can't reach it in time.  Where all paths take over ``few_states`` states,
    they are looked for in their order: over certain edges alone, then with probable, then with possible ones, and of each the
    shortest first; the search ends when enough are found, as all that is left is worse.  ``most_states`` fails the call, and
    never cuts the result, when a level grows past it; ``followed`` takes the number of states of each search.
    """
    S.between("max_depth", max_depth, 1, 8)
    semantic = F.col("kind").isin(S.SEMANTIC_KINDS).cast("int")
    edges = g.following(S.kinds_of(kinds, S.FLOW_KINDS), min_confidence).groupBy("source_id", "target_id").agg(F.max(F.struct("rank", semantic.alias("semantic"))).alias("best"))
    edges = stored(edges.select(F.col("source_id").alias("tip"), F.col("target_id").alias("next"), F.col("best.rank").alias("r"), F.col("best.semantic").alias("s")), "steps")
    starts, goals = stored(endpoints(g, start), "starts"), stored(endpoints(g, goal), "goals")
    followed = [] if followed is None else followed
    first = lambda df: df.orderBy(F.desc("rank"), "hops", F.desc("semantic"), "signature").limit(max_paths)

    def search(steps: DataFrame, away: DataFrame, hops: int, few: int | None = None) -> DataFrame | None:
        followed.append(0)

        def count(n: int, depth: int) -> bool:
            if few is None and most_states is not None and n > most_states:
                raise ValueError(f"more than {most_states} paths at depth {depth}")
            followed[-1] += n
            return few is None or followed[-1] <= few

        return _up_to(steps, away, starts, hops, count)

    away = _away(edges, goals, max_depth - 1)
    few = few_states if most_states is None else min(few_states, most_states)
    if (every := search(edges, away, max_depth, few)) is not None:
        return first(every)
    out, found = None, 0
    for least in range(3, S.least_rank(min_confidence) - 1, -1):
        if edges.where(F.col("r") == least).isEmpty():
            continue
        steps = edges.where(F.col("r") >= least)
        away = _away(steps, goals, max_depth - 1)
        nearest = starts.withColumnRenamed("id", "tip").join(steps, "tip").join(away, "next").agg(F.min("left")).first()[0]
        # The shortest alone, a little longer, and all: what one search found is found again by the next.
        for hops in sorted({min(nearest + 1, max_depth), min(nearest + 3, max_depth), max_depth}) if nearest is not None else ():
            hits = stored(search(steps, away, hops).where(F.col("rank") == least), "paths")
            if found + (n := hits.count()) >= max_paths:
                return first(hits if out is None else out.unionByName(hits))
        if nearest is not None:
            out, found = hits if out is None else out.unionByName(hits), found + n
    return first(g.spark.createDataFrame([], "signature string, hops int, rank int, semantic int") if out is None else out)
