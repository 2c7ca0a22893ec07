"""A trigram index of what lookups match: names, attributes and roles.

Components lie in blocks of neighbouring names, numbered within.  For each three lower-case characters and block the index holds
the places of the components that contain them, in order and as differences.  A term's trigrams are intersected block by
block; what is left is a superset of the matches, to be verified by the lookup itself.  Terms of less than three characters
tell nothing: then all components are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from ..graph import Graph
from ..storage import stored

#: Components of a block, about; postings of a trigram and block are no longer.
BLOCK = 8192
#: Parts into which postings are laid by their trigram.
PARTS = 64


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, lower-case."""
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, 3)))


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def differences(places: Column) -> Column:
    """Ascending numbers as the steps between them."""
    return F.filter(F.zip_with(places, F.concat(F.array(F.lit(0)), F.slice(places, F.lit(1), F.greatest(F.size(places) - 1, F.lit(0)))), lambda a, b: a - b), lambda x: x.isNotNull())


@F.pandas_udf(ArrayType(IntegerType()))
def summed(steps: pd.Series) -> pd.Series:
    """Steps as the numbers that they lead to."""
    return steps.map(lambda x: np.cumsum(x, dtype=np.int32))


def _posted(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's postings: each trigram with the steps between the places of the components that hold it."""
    places: dict[str, list[int]] = {}
    for place, low in rows[["place", "low"]].sort_values("place").itertuples(index=False):
        for gram in {low[i : i + 3] for i in range(len(low) - 2)}:
            places.setdefault(gram, []).append(place)
    return pd.DataFrame({"gram": list(places), "block": rows["block"].iloc[0], "steps": [np.diff(p, prepend=0).astype(np.int32) for p in places.values()]})


def build(g: Graph, block: int = BLOCK) -> dict[str, DataFrame]:
    """``names`` (components with block and place, laid by block) and ``postings`` (part, gram, block, steps, laid by part)."""
    blocks = max(1, -(-g.nodes.count() // block))
    roles = g.classifications.groupBy(F.col("node_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("role")), "\n").alias("roles"))
    laid = g.nodes.repartitionByRange(blocks, "canonical_name", "id").withColumn("block", F.spark_partition_id())
    names = stored(laid.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("canonical_name", "id"))), "names", by="block")
    text = F.concat_ws("\n", "canonical_name", "display_name", "attributes_json", "roles")
    # A block's texts are shuffled and not their trigrams, which are some eighty times as many rows.
    each = names.join(roles, "id", "left").select("block", "place", F.lower(text).alias("low")).where(F.length("low") >= 3)
    postings = each.groupBy("block").applyInPandas(_posted, "gram string, block int, steps array<int>")
    return {"names": names, "postings": stored(postings.select("gram", "block", "steps", _part(F.col("gram")).alias("part")).repartition("part"), "postings", by="part")}


def indexed(g: Graph, block: int = BLOCK) -> Graph:
    """The graph with an index that lookups use."""
    return g.with_tables(extras=g.extras | build(g, block))


def candidates(g: Graph, term: str) -> DataFrame | None:
    """``block, place`` of the components that hold all trigrams of a term; None where the graph has no index or the term no trigram."""
    low = term.lower()
    wanted = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if "postings" not in g.extras or not wanted:
        return None
    some = g.extras["postings"].where(F.col("gram").isin(wanted))
    parts = [r[0] for r in g.spark.createDataFrame([(w,) for w in wanted], "gram string").select(_part(F.col("gram"))).distinct().collect()]
    # A block's lists are as many as the term has trigrams.
    lists = some.where(F.col("part").isin(parts)).withColumn("places", summed("steps")).groupBy("block").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(wanted))
    both = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.get("lists", F.lit(0)), F.array_intersect)
    return lists.select("block", F.explode(both).alias("place"))


def narrowed(g: Graph, terms: list[str]) -> DataFrame:
    """Components that may match every term, with all columns of ``nodes``."""
    found = [c for t in terms if (c := candidates(g, t)) is not None]
    if not found:
        return g.nodes
    both = reduce(lambda a, b: a.join(b, ["block", "place"], "left_semi"), found)
    return g.extras["names"].join(both, ["block", "place"], "left_semi").select(*g.nodes.columns)
