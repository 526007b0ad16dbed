"""The mutable layer: insights that link to, duplicate and correlate with what is known.

Insights are (id, title, content, author, tags, confidence); their edges are
(src, rel, dst). All operators return new tables; the caller writes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scalars as s
from weftline.operators import matching, retrieval
from weftline.operators.graph import small
from weftline.session import checkpointed

#: Words that say nothing about a topic (our own short list).
STOP = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "not", "but", "has", "have", "had", "you", "all", "can", "its"]

#: Links of insights that are compared with as many others in a task.
BLOCK = 1 << 17


def keywords(text: F.Column) -> F.Column:
    return F.filter(s.query_tokens(text), lambda t: (F.octet_length(t) >= 3) & ~t.isin(*STOP))


def detect_links(insights: DataFrame, entities: DataFrame, most: int = 5, sure: float = 0.5) -> DataFrame:
    """(insight_id, entity_id, score, link_type): entities whose title or category holds a keyword; the score is the share of all the insight's terms found; the best ``most`` by terms found.

    All keywords are looked for in one pass over each entity's text; only pairs
    that share one are joined with their fields.
    """
    ins = insights.select(F.col("id").alias("insight_id"), keywords(F.concat_ws(" ", "title", "content")).alias("words"), s.query_tokens(F.concat_ws(" ", "title", "content")).alias("terms"))
    ent = entities.select(F.col("id").alias("entity_id"), F.lower(F.concat_ws(" ", "title", "category")).alias("field"))
    words = ins.select("insight_id", F.explode("words").alias("term"))
    met = matching.contained(ent, words.select("term"), "field")
    pairs = words.join(met, "term").select("insight_id", "entity_id").distinct().join(ent, "entity_id").join(ins.select("insight_id", "terms"), "insight_id")
    total = F.size(F.filter("terms", lambda t: F.contains(F.col("field"), t)))
    scored = pairs.select("insight_id", "entity_id", total.alias("total"), F.least(F.lit(1.0), total / F.size("terms")).alias("score"))
    own = Window.partitionBy("insight_id").orderBy(F.desc("total"), "entity_id")
    kind = F.when(F.col("score") >= sure, "auto").otherwise("suggested")
    return scored.withColumn("r", F.row_number().over(own)).filter(F.col("r") <= most).select("insight_id", "entity_id", "score", kind.alias("link_type"))


def correlations(edges: DataFrame, weights: tuple[float, float, float] = (0.4, 0.4, 0.2), temporal: float = 0.5, block: int = BLOCK) -> DataFrame:
    """(a, b, shared, combined) for pairs of insights sharing a target: Jaccard of their target sets, no semantic part, a constant temporal one.

    Insights stand in blocks of about ``block`` links with their numbered targets, and a
    task counts what two blocks share. Blocks are read again for each pair of
    them, so no pair of insights is ever shuffled, however many share a target.
    """
    spark = edges.sparkSession
    own = checkpointed(spark, edges.select("src", "dst").distinct())
    ids = checkpointed(spark, own.select("dst").filter("dst is not null").distinct().withColumn("target", F.monotonically_increasing_id()))
    n_blocks = max(1, -(-own.count() // block))
    each = own.filter("src is not null").join(ids, "dst", "left").groupBy("src").agg(F.count("*").alias("n"), F.collect_list("target").alias("targets"))
    blocks = each.groupBy(F.pmod(F.xxhash64("src"), F.lit(n_blocks)).alias("at")).agg(F.sort_array(F.collect_list(F.struct("src", "n", "targets"))).alias("rows"))
    blocks = checkpointed(spark, blocks.repartition(min(n_blocks, 64), "at"))
    both = blocks.toDF("lo", "x").hint("shuffle_replicate_nl").join(blocks.toDF("hi", "y"), F.col("lo") <= F.col("hi"))
    kind = own.schema["src"].dataType.simpleString()
    pairs = both.mapInArrow(_common, f"a {kind}, b {kind}, na long, nb long, both long")
    graph = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return pairs.select("a", "b", graph.alias("shared"), (graph * weights[0] + temporal * weights[2]).alias("combined"))


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of blocks (lo, x, hi, y) the pairs of insights with a common target."""

    def parts(rows: pa.Array) -> tuple:
        x = rows.flatten()
        targets = x.field("targets")
        return x.field("src"), x.field("n").to_numpy(), targets.flatten().to_numpy(), np.asarray(targets.value_lengths())

    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            same = row.column(0)[0] == row.column(2)[0]
            (a, na, ta, sa), (b, nb, tb, sb) = parts(row.column(1)), parts(row.column(3))
            order = np.argsort(tb, kind="stable")
            owner, sorted_ = np.repeat(np.arange(len(nb)), sb)[order], tb[order]
            lo, hi = np.searchsorted(sorted_, ta), np.searchsorted(sorted_, ta, "right")
            ends, held, size = np.append(0, np.cumsum(sa)), [], 0
            for i in range(len(na) + 1):
                if held and (i == len(na) or size > 1 << 16):
                    p, q, n = (np.concatenate(v) for v in zip(*held))
                    left, right = a.take(pa.array(p)), b.take(pa.array(q))
                    less = pc.less(left, right)
                    swap = lambda u, v: pa.array(np.where(less.to_numpy(zero_copy_only=False), u, v))  # noqa: E731, B023
                    yield pa.record_batch([pc.if_else(less, left, right), pc.if_else(less, right, left), swap(na[p], nb[q]), swap(nb[q], na[p]), pa.array(n)], ["a", "b", "na", "nb", "both"])
                    held, size = [], 0
                if i < len(na):
                    own = [owner[u:v] for u, v in zip(lo[ends[i] : ends[i + 1]], hi[ends[i] : ends[i + 1]])]
                    n = np.bincount(np.concatenate(own), minlength=len(nb)) if own else np.zeros(len(nb), np.int64)
                    if same:
                        n[: i + 1] = 0
                    at = np.flatnonzero(n)
                    if len(at):
                        held.append((np.full(len(at), i), at, n[at]))
                        size += len(at)


def confirm(edges: DataFrame, confidence: DataFrame, accepted: DataFrame, step: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Adds accepted links (insight_id, entity_id) as derives_from and raises confidence (id, confidence) by a step for each, up to 1."""
    added = edges.unionByName(accepted.select(F.col("insight_id").alias("src"), F.lit("derives_from").alias("rel"), F.col("entity_id").alias("dst")))
    n = accepted.groupBy(F.col("insight_id").alias("id")).agg(F.count("*").alias("n"))
    raised = confidence.join(n, "id", "left").select("id", F.least(F.lit(1.0), F.col("confidence") + step * F.coalesce("n", F.lit(0))).alias("confidence"))
    return added, raised


def add(insights: DataFrame, new: DataFrame, project: str | None = None, confidence: float = 0.5) -> DataFrame:
    """Appends (title, content, author, tags), ids going on from the largest number in use; the order of new rows is by title and content."""
    last = insights.agg(F.coalesce(F.max(F.expr("try_cast(substring(id, 4) AS int)")), F.lit(0)).alias("last"))
    ranked = new.withColumn("n", F.row_number().over(Window.orderBy("title", "content")))  # one writer: a batch of notes typed by people
    tags = F.array_union("tags", F.array(F.lit(f"project:{project}"))) if project else F.col("tags")
    made = ranked.join(F.broadcast(last)).select(s.next_id(F.col("last"), F.col("n")).alias("id"), s.truncate(F.col("title"), 80).alias("title"), "content", "author", tags.alias("tags"), F.lit(confidence).alias("confidence"))
    return insights.unionByName(made)


def persist_findings(insights: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings (location, name, smell_id, confidence) as notes, unless one with the same found_in tag and smell is kept."""
    key = F.concat(F.lit("found_in:"), "location", F.lit(":"), "name", F.lit(":"), "smell_id")
    new = findings.withColumn("key", key).dropDuplicates(["key"])
    kept = insights.select(F.explode("tags").alias("key"))
    return new.join(kept, "key", "left_anti").select("key", "location", "name", "smell_id", "confidence")


def by_source(insights: DataFrame, source: str = "all", limit: int = 20) -> DataFrame:
    """Notes of users, of analyses or of all, newest first by id; at most 200."""
    own = insights if source == "all" else insights.filter((F.col("author") == "analysis") == (source == "analysis"))
    return own.orderBy(F.desc("id")).limit(min(200, max(1, limit)))


def _as_chunks(insights: DataFrame) -> DataFrame:
    return insights.select("id", F.col("content").alias("text"), "title", F.array_join("tags", " ").alias("section"))


def search(insights: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, id, score, rank): notes that hold all of a query's words in title, content or tags, by BM25."""
    return retrieval.top(retrieval.bm25(retrieval.postings(_as_chunks(insights)), queries), limit)


def duplicates(insights: DataFrame, new: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, id, score, rank, match) for new notes (query_id, title, content): kept notes with all their words; a match is always called partial."""
    return search(insights, new.select("query_id", F.concat_ws(" ", "title", "content").alias("query")), limit).withColumn("match", F.lit("partial"))


def facets(insights: DataFrame) -> DataFrame:
    """(project, n): the projects among the notes' tags, sorted."""
    tag = insights.select(F.explode("tags").alias("tag")).filter(F.startswith("tag", F.lit("project:")))
    return tag.groupBy(F.expr("substring(tag, 9)").alias("project")).agg(F.count("*").alias("n")).orderBy("project")


def supersede(edges: DataFrame, given: DataFrame, provenance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepts links (insight_id, entity_id, score, source) and notes replaced (insight_id, entity_id with source 'supersedes'): the edges, and of each link's provenance (insight_id, entity_id, source, score) the higher score."""
    rel = F.when(F.col("source") == "supersedes", "supersedes").otherwise("derives_from")
    more = given.select(F.col("insight_id").alias("src"), rel.alias("rel"), F.col("entity_id").alias("dst"))
    both = provenance.unionByName(given.select(provenance.columns))
    best = both.groupBy("insight_id", "entity_id").agg(F.max(F.struct("score", "source")).alias("b")).select("insight_id", "entity_id", "b.source", "b.score")
    return edges.unionByName(more), best.select(provenance.columns)
