"""The facade: tables in, the tools' answers out as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import detectors, graph, insights, retrieval
from weftline.session import checkpointed
from weftline.sources import code_items, files


@dataclass
class Engine:
    """Holds the tables; every method is one lazy plan.

    entities (id, type, title, category), edges (src, rel, dst), chunks (id,
    text, entity_id, entity_type, title, section), vectors (id, entity_id, vec),
    lexicons: synonyms (term, entity_id), homonyms (entity_id, term), types
    (key, term). User notes are a second layer of entities and edges.
    """

    spark: SparkSession
    entities: DataFrame
    edges: DataFrame
    chunks: DataFrame | None = None
    vectors: DataFrame | None = None
    synonyms: DataFrame | None = None
    homonyms: DataFrame | None = None
    types: DataFrame | None = None
    user_entities: DataFrame | None = None
    user_edges: DataFrame | None = None

    @classmethod
    def from_json(cls, spark: SparkSession, path: str, **more) -> Engine:
        e, x = files.load_graph(spark, path)
        return cls(spark, e, x, **more)

    # graph

    def layer(self, layer: str = "canonical") -> DataFrame:
        """Edges of the canonical graph, or of both layers with user edges walkable in both directions."""
        if layer == "canonical" or self.user_edges is None:
            return self.edges
        back = self.user_edges.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"))
        return self.edges.unionByName(self.user_edges).unionByName(back).distinct()

    def all_entities(self) -> DataFrame:
        return self.entities if self.user_entities is None else graph.layered(self.entities, self.user_entities)

    def entity(self, node: str) -> DataFrame:
        return self.all_entities().filter(F.col("id") == node)

    def neighbors(self, node: str, rel: str | None = None) -> DataFrame:
        return graph.labelled(graph.neighbors(self.edges, node, rel), self.entities)

    def neighborhood(self, node: str) -> DataFrame:
        return graph.neighborhood(self.layer("composite"), node)

    def path(self, source: str, target: str, max_depth: int = 5, layer: str = "canonical") -> DataFrame:
        return graph.shortest_path(self.spark, self.layer(layer), self.all_entities(), source, target, max_depth)

    def subgraph(self, center: str, radius: int = 2) -> DataFrame:
        return graph.subgraph(self.spark, self.edges, self.entities, center, radius)

    def contradictions(self) -> DataFrame:
        return graph.contradictions(self.edges, self.entities)

    def infer(self) -> DataFrame:
        return graph.transitive_enforcements(self.edges)

    def similar(self, node: str, threshold: float) -> DataFrame:
        return graph.similar(self.edges, node, threshold)

    def stats(self) -> DataFrame:
        return graph.stats(self.all_entities(), self.layer("composite"))

    # retrieval

    def search(self, queries: DataFrame, limit: int = 5, entity_type: str | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
        """(query_id, entity_id, score, rank, type, title) for queries (query_id, query); limit is clamped to 1..20; blank queries give nothing. Queries without results are answered by words of the entities, their number being the score."""
        limit = min(20, max(1, limit))
        asked = queries.filter(F.trim("query") != "")
        if entity_type is None and self.types is not None:
            found = self._by_types(asked, limit, query_vectors)
        else:
            found = self._hybrid(asked, limit, entity_type, query_vectors)
        return self._enriched(asked, found, limit, entity_type)

    def _hybrid(self, asked: DataFrame, limit: int, entity_type: str | None, query_vectors: DataFrame | None) -> DataFrame:
        """(query_id, entity_id, score): keyword and semantic hits fused, or keyword hits alone without vectors."""
        own = self.chunks if entity_type is None else self.chunks.filter(F.col("entity_type") == entity_type)
        hits = retrieval.keyword_search(None, own, asked, retrieval.OVERFETCH * limit)
        demoted = retrieval.homonym_hits(asked, self.homonyms) if self.homonyms is not None else None
        if self.vectors is None or query_vectors is None:
            one = retrieval.one_sided(hits.select("query_id", "id", "entity_id", "score"), limit)
            found = one if demoted is None else one.join(demoted, ["query_id", "entity_id"], "left_anti")
        else:
            near = self.vectors if entity_type is None else self.vectors.join(own.select("id"), "id", "left_semi")
            meant = query_vectors.join(asked.select("query_id"), "query_id", "left_semi")
            meaning = retrieval.semantic_search(near, meant, retrieval.OVERFETCH * limit, chunks=self.chunks, asked=asked, types=self.types)
            found = retrieval.fuse(hits, meaning, limit, homonyms=demoted)
        return found.select("query_id", "entity_id", F.col("score").cast("double").alias("score"))

    def _by_types(self, asked: DataFrame, limit: int, query_vectors: DataFrame | None) -> DataFrame:
        """One search for each type that a query's words point to, merged by score; one over all types for queries that point to none."""
        named = checkpointed(self.spark, retrieval.detect_types(asked, self.types).select("query_id", "key"))
        parts = [self._hybrid(asked.join(named, "query_id", "left_anti"), limit, None, query_vectors)]
        for kind in [r.key for r in self.types.select("key").distinct().orderBy("key").collect()]:  # the lexicon's types are few
            parts.append(self._hybrid(asked.join(named.filter(F.col("key") == kind), "query_id", "left_semi"), limit, kind, query_vectors))
        return retrieval.merge_types(reduce(DataFrame.unionByName, parts), limit).select("query_id", "entity_id", "score")

    def _enriched(self, asked: DataFrame, found: DataFrame, limit: int, entity_type: str | None) -> DataFrame:
        """Synonyms, related remedies, the answer by words of the entities where nothing was found, and names."""
        found = found.select("query_id", "entity_id", "score").groupBy("query_id", "entity_id").agg(F.max("score").alias("score"))
        if self.synonyms is not None:
            found = retrieval.inject_synonyms(found, asked, self.synonyms)
        ranked = retrieval.expand_remedies(found, self.edges, limit).select("query_id", "entity_id", "score", "rank")
        known = self.entities if entity_type is None else self.entities.filter(F.col("type") == entity_type)
        left = retrieval.graph_fallback(known, asked.join(found, "query_id", "left_anti"), limit, retrieval.homonym_hits(asked, self.homonyms) if self.homonyms is not None else None)
        ranked = ranked.unionByName(left.select("query_id", F.col("id").alias("entity_id"), F.col("total").cast("double").alias("score"), "rank"))
        return ranked.join(self.entities.select(F.col("id").alias("entity_id"), "type", "title"), "entity_id", "left")

    # code

    def analyze(self, code_files: DataFrame, min_confidence: float = 0.0) -> DataFrame:
        return detectors.detect_all(code_items.code_items(code_files), min_confidence)

    def refactor(self, code_files: DataFrame, remedies: DataFrame, top_k: int = 3, min_confidence: float = 0.5) -> DataFrame:
        return detectors.rank_remedies(self.analyze(code_files, min_confidence), self.edges, remedies, top_k)

    def audit(self, code_files: DataFrame) -> DataFrame:
        return detectors.severity(self.analyze(code_files))

    # notes

    def link(self, notes: DataFrame) -> DataFrame:
        return insights.detect_links(notes, self.entities)

    def correlate(self) -> DataFrame:
        return insights.correlations(self.user_edges)

    def context(self, results: DataFrame, budget: int) -> DataFrame:
        """Detail levels of ranked results (query_id, rank, and an entity's id, title, type, category, context) under a token budget."""
        return retrieval.budget(retrieval.costed(results), budget)


def detail_level(query: str, budget: int) -> str:
    """The level that a query and a budget ask for."""
    if any(w in query.lower() for w in ("explain", "detail", "how", "why")):
        return "detailed"
    return "minimal" if budget < 100 else "summary" if budget < 300 else "detailed"


