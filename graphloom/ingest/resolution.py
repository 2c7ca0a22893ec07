"""What a reference names, decided once for each distinct reference and only as far as it is asked.

A member that its type doesn't declare is looked for upward: only such members walk, a level at a time,
through what their type is composed of, and leave at the level of the first hit.  No closure over types is ever made.
``reads`` keeps what each decision looked at, so that a later scan knows which decisions a change can touch:

``n|ref``  whether a declaration of that reference exists
``u|ref``  what that type is composed of
``r|ref``  which type that member returns
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..storage import stored

#: Kinds that one name may be declared as, in the order they are tried.
TYPE_KINDS = ["class", "interface", "trait", "enum"]
MEMBER_KINDS = ["method", "property"]
#: Relationships that hand members down, in the order they are searched.
COMPOSITION = ["uses_trait", "extends", "implements"]
MAX_DEPTH = 20

REFERENCES = "target string, target_id string, t_lang string, t_kind string, t_name string, external boolean, status string"


def well_formed(ref: Column) -> Column:
    parts = F.split(ref, ":", 3)
    return (F.size(parts) == 3) & ~F.exists(parts, lambda p: p == "")


def part_of(ref: Column | str, number: int) -> Column:
    return F.get(F.split(ref, ":", 3), F.lit(number))


def owner_and_member(name: Column) -> tuple[Column, Column]:
    """Before and after the last ``::``; empty where there is none."""
    pattern = r"(?s)^(.+)::((?:(?!::).)+)$"
    return F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)


def above_of(column: str) -> Column:
    return owner_and_member(F.col(column))[0]


def member_of(column: str) -> Column:
    return owner_and_member(F.col(column))[1]


def links(edges: DataFrame) -> DataFrame:
    """What each type is composed of, in the order it is searched: ``ref, above, turn``; traits before parents before interfaces."""
    order = F.array_position(F.array(*[F.lit(k) for k in COMPOSITION]), F.col("kind"))
    first = edges.where(F.col("kind").isin(COMPOSITION)).groupBy(F.col("source").alias("ref"), F.col("target").alias("above")).agg(F.min(F.struct(order.alias("o"), "file", "place")).alias("at"))
    return first.select("ref", "above", F.row_number().over(Window.partitionBy("ref").orderBy("at", "above")).alias("turn"))


def returned(edges: DataFrame) -> DataFrame:
    """The type that each member is told to return, by the first word on it: ``ref, returned``."""
    return edges.where("kind = 'returns'").groupBy(F.col("source").alias("ref")).agg(F.min_by("target", F.struct("file", "place")).alias("returned"))


@dataclass(frozen=True)
class Known:
    """What references are decided by.  ``declared``: ref, id; ``links`` and ``returned`` as above."""

    declared: DataFrame
    links: DataFrame
    returned: DataFrame

    @staticmethod
    def of(edges: DataFrame, nodes: DataFrame) -> Known:
        return Known(nodes.select("ref", "id"), links(edges), returned(edges))


KEY = ["lang", "type", "probe"]


def walk(asked: DataFrame, links: DataFrame, holders: DataFrame, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """The nearest type above that holds what is asked, and every type looked at on the way.

    ``asked``: ``lang, type, probe``; ``holders``: ``lang, type, probe, value``.  Gives ``lang, type, probe, value`` and
    ``lang, type, probe, ref, depth``.  Breadth first: of a level the type whose path took the earlier turns comes first,
    and what a path has seen before is not looked at again.  Types of another language hold nothing and lead nowhere.
    """
    kinds = F.posexplode(F.array(*[F.lit(k) for k in TYPE_KINDS])).alias("at", "type_kind")
    frontier = asked.select(*KEY).distinct().select(*KEY, kinds).select(*KEY, F.concat_ws(":", "lang", "type_kind", "type").alias("from"), F.array("at").alias("path"))
    at, above, visited = holders.select("lang", F.col("type").alias("above"), "probe", "value"), links.withColumnRenamed("ref", "from"), None
    for depth in range(1, max_depth + 1):
        step = frontier.join(above, "from").groupBy(*KEY, F.col("above").alias("ref")).agg(F.min(F.array_append("path", F.col("turn"))).alias("path"))
        if visited is not None:
            step = step.join(visited.select(*KEY, "ref"), [*KEY, "ref"], "left_anti")
        own = F.when(well_formed(F.col("ref")) & (part_of("ref", 0) == F.col("lang")), part_of("ref", 2))
        step = stored(step.withColumn("above", own).join(at, ["lang", "above", "probe"], "left").select(*KEY, "ref", "path", "above", "value", F.lit(depth).alias("depth")), "walk")
        if step.isEmpty():
            break
        visited = step if visited is None else visited.unionByName(step)
        frontier = step.where("above IS NOT NULL").join(step.where("value IS NOT NULL").select(*KEY), KEY, "left_anti").select(*KEY, F.col("ref").alias("from"), "path")
    # What is found at one level isn't asked at the next.
    visited = step if visited is None else visited
    return visited.where("value IS NOT NULL").groupBy(*KEY).agg(F.min_by("value", "path").alias("value")), visited.select(*KEY, "ref", "depth")


def _walked(asked: DataFrame, visited: DataFrame, probe_key: str, kind: Column) -> DataFrame:
    """``target, key``: what walks read.  ``asked``: ``target, lang, type, probe, member``."""
    started = asked.select("target", F.explode(F.transform(F.array(*[F.lit(k) for k in TYPE_KINDS]), lambda k: F.concat(F.lit("u|"), F.concat_ws(":", "lang", k, "type")))).alias("key"))
    seen = asked.join(visited, KEY)
    held = F.concat(F.lit(probe_key), F.concat_ws(":", "lang", kind, F.concat(part_of("ref", 2), F.lit("::"), "member")))
    # A type of another language is passed over, whatever it is composed of.
    return started.unionByName(seen.select("target", F.explode(F.array(F.concat(F.lit("u|"), "ref"), held)).alias("key")))


def resolve_references(refs: DataFrame, known: Known, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Each distinct ``target`` with what it names, and what that was read from (``target, key``).

    In order: the reference itself; the same name as another kind of type; a member of the nearest type above; an external
    symbol.  Kind ``namespaced_function`` is the namespace's function if that is declared, and else the global one, declared or not.
    Kind ``method_of_return`` is a member of what the named call returns.  ``status`` is resolved, external, dropped (such
    a member that isn't known) or malformed (not three parts); the last two have no ``target_id``.
    """
    refs = stored(refs.select("target").where("target IS NOT NULL").distinct(), "references")
    declared = known.declared
    waiting = F.col("target").contains(":method_of_return:")

    # A member of what a call returns: the call's own type, or that of the nearest type above that has the call.
    owner, member = owner_and_member(part_of("target", 2))
    deferred = refs.where(waiting).select("target", part_of("target", 0).alias("lang"), part_of("target", 1).alias("r_kind"), owner.alias("call"), member.alias("wanted"))
    deferred = deferred.where("r_kind = 'method_of_return' AND call <> '' AND wanted <> ''").withColumn("call_ref", F.concat_ws(":", "lang", F.lit("method"), "call"))
    told = stored(deferred.join(known.returned.withColumnRenamed("ref", "call_ref"), "call_ref", "left"), "told")
    calls = told.where("returned IS NULL").select("target", "lang", above_of("call").alias("type"), member_of("call").alias("probe"), member_of("call").alias("member")).where("type <> '' AND probe <> ''")
    r_owner, r_name = owner_and_member(part_of("ref", 2))
    makers = known.returned.where(part_of("ref", 1) == "method").select(part_of("ref", 0).alias("lang"), r_owner.alias("type"), r_name.alias("probe"), F.col("returned").alias("value"))
    made, looked = walk(calls, known.links, makers, max_depth)
    by_type = calls.join(made, KEY).select("target", F.col("value").alias("inherited_return"))
    back = F.coalesce("returned", "inherited_return")
    goal = F.when(part_of(back, 2) != "", F.concat(F.col("lang"), F.lit(":method:"), part_of(back, 2), F.lit("::"), F.col("wanted")))
    turned = told.join(by_type, "target", "left").select("target", goal.alias("goal"))

    # An unqualified function of a namespace.
    spaced = refs.where(~waiting & F.col("target").contains(":namespaced_function:")).select("target", part_of("target", 0).alias("lang"), part_of("target", 2).alias("name"))
    own_ref = F.concat_ws(":", "lang", F.lit("function"), "name")
    global_ref = F.concat_ws(":", "lang", F.lit("function"), F.element_at(F.split("name", r"\\"), -1))
    is_name = F.col("name").isNotNull() & (F.col("name") != "")
    spaced = spaced.withColumns({"own": F.when(is_name, own_ref), "other": F.when(is_name, global_ref).otherwise(F.col("target"))})
    named = spaced.join(declared.select(F.col("ref").alias("own"), F.col("id").alias("own_id")), "own", "left").select("target", F.when(F.col("own_id").isNotNull(), F.col("own")).otherwise(F.col("other")).alias("goal"), "own")

    plain = refs.where(~waiting & ~F.col("target").contains(":namespaced_function:")).select("target", F.col("target").alias("goal"))
    goals = plain.withColumn("deferred", F.lit(False)).unionByName(named.select("target", "goal").withColumn("deferred", F.lit(False)))
    goals = goals.unionByName(refs.where(waiting).join(turned, "target", "left").select("target", "goal").withColumn("deferred", F.lit(True)))
    goals = goals.withColumns({"ok": F.coalesce(well_formed(F.col("goal")), F.lit(False)), "t_lang": part_of("goal", 0), "t_kind": part_of("goal", 1), "t_name": part_of("goal", 2)})
    exact = goals.join(declared.select(F.col("ref").alias("goal"), F.col("id").alias("exact")), "goal", "left")

    # The same name as another kind of type, by a few equi-joins' worth of rows: one for each kind and type reference that missed.
    kinds = F.array(*[F.lit(k) for k in TYPE_KINDS])
    other = exact.where(F.col("exact").isNull() & F.col("t_kind").isin(TYPE_KINDS)).select("target", "t_lang", "t_name", F.posexplode(kinds).alias("turn", "k")).select("target", "turn", F.concat_ws(":", "t_lang", "k", "t_name").alias("ref"))
    alias = other.join(declared, "ref").groupBy("target").agg(F.min_by("id", "turn").alias("alias"))
    tried = stored(exact.join(alias, "target", "left"), "tried")

    probe = F.concat_ws(":", "t_kind", member_of("t_name"))
    up = tried.where(F.col("exact").isNull() & F.col("alias").isNull() & F.col("t_kind").isin(MEMBER_KINDS)).select("target", F.col("t_lang").alias("lang"), "t_kind", above_of("t_name").alias("type"), probe.alias("probe"), member_of("t_name").alias("member")).where("type <> '' AND member <> ''")
    d_owner, d_name = owner_and_member(part_of("ref", 2))
    holders = declared.where(part_of("ref", 1).isin(MEMBER_KINDS)).select(part_of("ref", 0).alias("lang"), d_owner.alias("type"), F.concat_ws(":", part_of("ref", 1), d_name).alias("probe"), F.col("id").alias("value"))
    inherited, seen = walk(up, known.links, holders, max_depth)
    out = tried.join(up.join(inherited, KEY).select("target", F.col("value").alias("inherited")), "target", "left")

    hit = F.coalesce("exact", "alias", "inherited")
    external = stable_id("symbol", F.lit("external"), F.col("t_lang"), F.concat(F.lit("external_"), F.col("t_kind")), F.col("t_name"))
    status = F.when(hit.isNotNull(), "resolved").when(F.col("deferred"), "dropped").when(F.col("ok"), "external").otherwise("malformed")
    out = out.withColumn("status", status).withColumn("target_id", F.when(F.col("status") == "resolved", hit).when(F.col("status") == "external", external)).withColumn("external", F.col("status") == "external")

    key = lambda prefix, ref: F.concat(F.lit(prefix), ref).alias("key")
    reads = [
        told.select("target", key("r|", F.col("call_ref"))),
        _walked(calls, looked, "r|", F.lit("method")),
        named.where("own IS NOT NULL").select("target", key("n|", F.col("own"))),
        tried.where("ok").select("target", key("n|", F.col("goal"))),
        tried.where(F.col("t_kind").isin(TYPE_KINDS) & F.col("ok")).select("target", F.explode(F.transform(kinds, lambda k: F.concat(F.lit("n|"), F.concat_ws(":", "t_lang", k, "t_name")))).alias("key")),
        _walked(up, seen, "n|", F.col("t_kind")),
    ]
    return out.select("target", "target_id", "t_lang", "t_kind", "t_name", "external", "status"), reduce(DataFrame.unionByName, reads).where("key IS NOT NULL").distinct()
