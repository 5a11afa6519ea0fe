"""Entities by parts of their names, one step around them, and chunks they bring to a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms
from ..session import stash

#: Names are found by runs of so many characters; shorter probes by themselves.
GRAM = 3


def runs(text: Column, size: Column) -> Column:
    """The distinct runs of `size` characters of a text that has as many."""
    at = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, size))))


def name_index(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (gram, id, name) of names (id, name) without case, by runs of one to three characters; and how many each run has."""
    low = names.select("id", F.lower("name").alias("name"))
    grams = F.explode(F.flatten(F.array_compact(F.array(*(runs(F.col("name"), F.lit(n)) for n in range(1, GRAM + 1))))))
    postings = stash(low.select(grams.alias("gram"), "id", "name"))
    return postings, stash(postings.groupBy("gram").agg(F.count("*").alias("n")))


def find_names(probes: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """(probe, id, rank): of each distinct probe the first `most` names (id, name) by id that contain it, without case. A probe meets
    only the postings of its rarest run; blank probes find nothing."""
    asked = probes.select(F.trim("probe").alias("probe")).where("probe != ''").distinct().withColumn("low", F.lower("probe"))
    size = F.least(F.length("low"), F.lit(GRAM))
    # of equal names only the first by id can be among the first of a probe
    low = names.select("id", F.lower("name").alias("name"))
    few = low.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where(F.col("r") <= most).drop("r")
    postings, counts = name_index(few)
    grams = asked.select("probe", "low", F.explode(runs(F.col("low"), size)).alias("gram")).join(counts, "gram", "left")
    # a probe with a run that no name has is in no name
    rarest = grams.groupBy("probe", "low").agg(F.count_if(F.col("n").isNull()).alias("absent"), F.min(F.struct("n", "gram"))["gram"].alias("gram")).where("absent = 0")
    met = rarest.select("probe", "low", "gram").join(postings, "gram").where(F.contains("name", "low"))
    w = Window.partitionBy("probe").orderBy("id")
    return met.select("probe", "id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def entity_search(probes: DataFrame, entities: DataFrame, relations: DataFrame, most: int = 5, neighbours: int = 10) -> dict[str, DataFrame]:
    """What distinct probes (probe) find among active entities (id, name, chunk_id, active): `entities` (probe, id, rank), the first by
    id; `edges` (probe, relation_id), active relations (relation_id, source, target, chunk_id, active) from or to them; `neighbours`
    (probe, id, rank), the first active entities at their other ends that the probe did not find; and `chunks` (probe, chunk_id) of
    the entities and of relations from them."""
    live = entities.where("active")
    found = stash(find_names(probes, live, most))
    ties = relations.where("active")
    out = found.select("probe", F.col("id").alias("source")).join(ties, "source")
    back = found.select("probe", F.col("id").alias("target")).join(ties, "target")
    ends = out.select("probe", F.col("target").alias("id")).unionByName(back.select("probe", F.col("source").alias("id"))).distinct()
    near = ends.join(found.select("probe", "id"), ["probe", "id"], "left_anti").join(live.select("id"), "id", "left_semi")
    w = Window.partitionBy("probe").orderBy("id")
    own = found.join(live.select("id", "chunk_id"), "id").select("probe", "chunk_id")
    return {
        "entities": found,
        "edges": out.select("probe", "relation_id").unionByName(back.select("probe", "relation_id")).distinct(),
        "neighbours": near.select("probe", "id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= neighbours),
        "chunks": own.unionByName(out.select("probe", "chunk_id")).where("chunk_id is not null").distinct(),
    }


def graph_expand(queries: DataFrame, hits: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame, most: int = 20, score: float = 0.5) -> DataFrame:
    """(query_id, chunk_id, score, place): chunks that entities bring to queries (query_id, text), each once: those of the whole
    question first, then those of its terms in order. Only active chunks (chunk_id, active), none that hits (query_id, chunk_id) has,
    and at most `most` for a query."""
    text = F.trim("text")
    # equal questions ask the same probes: each text is worked out once
    same = stash(queries.select("query_id", text.alias("text")).where("text is not null"))
    probes = F.concat(F.array("text"), query_terms(F.col("text")))
    asked = same.select("text").distinct().select("text", F.posexplode(probes).alias("at", "probe")).select("text", "at", F.trim("probe").alias("probe"))
    asked = stash(asked.groupBy("text", "probe").agg(F.min("at").alias("at")))
    live = chunks.where("active").select("chunk_id").distinct()
    brought = entity_search(asked.select("probe"), entities, relations)["chunks"].join(live, "chunk_id", "left_semi")
    rows = asked.join(brought, "probe").groupBy("text", "chunk_id").agg(F.min("at").alias("at"))
    order = Window.partitionBy("text").orderBy("at", "chunk_id")
    rows = rows.withColumn("r", F.row_number().over(order))
    # a query with n hits finds its first `most` among the first `most` + n of its text
    found = hits.select("query_id", "chunk_id").distinct()
    n = found.groupBy("query_id").agg(F.count("*").alias("n"))
    wanted = stash(same.join(n, "query_id", "left").select("query_id", "text", (F.coalesce("n", F.lit(0)) + most).alias("last")))
    longest = wanted.groupBy("text").agg(F.max("last").alias("longest"))
    rows = stash(rows.join(longest, "text").where("r <= longest").select("text", "r", "at", "chunk_id"))
    mine = wanted.join(rows, "text").where("r <= last").groupBy("query_id", "chunk_id").agg(F.min("at").alias("at"))
    mine = mine.join(found, ["query_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("at", "chunk_id")
    return mine.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query_id", "chunk_id", F.lit(score).alias("score"), "place")
