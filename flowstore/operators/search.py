"""Text search by BM25 over one table of postings."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstore.functions.text import tokens
from flowstore.plans.tables import cut

K1, B = 1.2, 0.75
#: Partitions of written postings: a term is in one of them, in order, so that a search reads few row groups.
PARTS = 64


@dataclass
class TextIndex:
    """postings (term, doc, tf, length of the document, group), totals: one row (n, total) of documents and their words."""

    postings: DataFrame
    totals: DataFrame


def build(docs: DataFrame, key: str, text: str, persist: bool = False, group: str | None = None) -> TextIndex:
    """The index of a table; a null text is an empty document. group is a column that searches can be
    limited by. persist writes the tables, so that many searches read them.
    """
    rows = docs.select(F.col(f"`{key}`").alias("doc"), (F.col(f"`{group}`") if group else F.lit(None).cast("string")).alias("group"), tokens(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("t"))
    words = rows.select("doc", "group", F.size("t").alias("length"), F.explode("t").alias("term"))
    postings = words.groupBy("term", "doc", "length", "group").agg(F.count("*").alias("tf"))
    totals = rows.agg(F.count("*").alias("n"), F.sum(F.size("t")).alias("total"))
    if persist:
        postings, totals = cut(postings.repartition(PARTS, "term").sortWithinPartitions("term")), cut(totals)
    return TextIndex(postings, totals)


def search(index: TextIndex, query: str, limit: int | None = 10, group: object = None) -> DataFrame:
    """(doc, score) of documents with any word of the query, the best first, ties by doc; a word counts as often as the query has it. With group, only documents of that group, weighed as in the whole.

    Only postings of the query's words are read, once, as both uses of them have one
    exchange. A document's length is in its postings; the totals are one row.
    """
    spark = index.postings.sparkSession
    times = Counter(spark.range(1).select(tokens(F.lit(query)).alias("t")).first().t)
    hits = index.postings.where(F.col("term").isin(list(times)) if times else F.lit(False))
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in times.items() for x in pair]), F.col("term")) if times else F.lit(0)
    df = hits.groupBy("term").agg(F.count("*").alias("df")).crossJoin(index.totals)  # one row against one a word
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    stats = F.broadcast(df.select("term", (idf * weight).alias("idf"), (F.col("total") / F.col("n")).alias("average")))  # the words of one query
    scored = (hits if group is None else hits.where(F.col("group") == group)).join(stats, "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    out = scored.groupBy("doc").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "doc")
    return out if limit is None else out.limit(limit)
