"""Scholarly works in OpenAlex's JSON lines, as papers and the citations among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.scalars import text_embedding
from arcweave.sources.graph import Edge, Graph
from arcweave.sources.keys import keyed, visible

SCHEMA = (
    "id string, display_name string, publication_year long, cited_by_count long, doi string, concepts array<struct<display_name: string, level: long>>, "
    "authorships array<struct<author: struct<display_name: string>>>, referenced_works array<string>"
)


def number_of(url: Column) -> Column:
    """The number of a work's address, as 7 of `https://…/W7`; null for any other."""
    return F.regexp_extract(F.substring_index(url, "/", -1), r"^W(\d{1,18})$", 1).try_cast("long")


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """One row a work that has a number and a year, from ``part_*.gz`` anywhere under ``folder``.

    Of a work that is there more than once the most cited row counts, then the greatest by its
    columns. field is the first concept of level 1 or more, else the first, else `Unknown`.
    """
    raw = spark.read.schema(SCHEMA).option("pathGlobFilter", "part_*.gz").option("recursiveFileLookup", True).json(folder)
    concepts = F.col("concepts")
    concept = F.coalesce(F.get(F.filter(concepts, lambda c: c["level"] >= 1), F.lit(0)), F.get(concepts, F.lit(0)))
    told = raw.where("publication_year <> 0").select(
        number_of(F.col("id")).alias("number"),
        F.coalesce("cited_by_count", F.lit(0)).alias("citations"),
        F.col("publication_year").alias("year"),
        F.coalesce("display_name", F.lit("(untitled)")).alias("name"),
        F.coalesce(concept["display_name"], F.lit("Unknown")).alias("field"),
        F.coalesce("doi", F.lit("")).alias("doi"),
        F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda a: a.isNotNull()).alias("authors"),
        F.filter(F.transform("referenced_works", number_of), lambda n: n.isNotNull()).alias("cited"),
    )
    rest = [c for c in told.columns if c != "number"]
    best = told.where("number IS NOT NULL").groupBy("number").agg(F.max(F.struct(*rest)).alias("w"))
    return best.select("number", *[f"w.{c}" for c in rest])


def citations(works: DataFrame) -> DataFrame:
    """(citing, cited): each reference from one of ``works`` to another of them, as often as it is listed."""
    listed = works.select(F.col("number").alias("citing"), F.explode("cited").alias("cited")).where("citing <> cited")
    return listed.join(works.select(F.col("number").alias("cited")), "cited", "left_semi").select("citing", "cited")


def graph(spark: SparkSession, folder: str) -> Graph:
    """Papers, with an embedding of title and field, joined by `cites` (citing, cited)."""
    works = papers(spark, folder)
    shown = [c for c in works.columns if c not in ("number", "cited")]
    entity = works.select(*keyed("id", "paper", F.col("number")), *shown, text_embedding(F.concat_ws(" ", "name", "field")).alias("embedding"))
    edges = citations(works).select(*keyed("citing", "paper", F.col("citing")), *keyed("cited", "paper", F.col("cited")))
    return Graph(entities={"paper": entity}, edges={"cites": Edge(edges, ["citing", "cited"])})
