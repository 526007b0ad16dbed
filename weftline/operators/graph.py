"""Property-graph operators over edges (src, rel, dst) and entities (id, type, title, category).

Everything is a declarative plan. Hop loops build at most ``max_depth`` joins;
the frontier is deduplicated and checked against what was visited at each hop,
and lineage is cut through the shared checkpoint folder. Ties break by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.session import checkpointed

#: Relations with an inverse (fixed values).
INVERSE = {"solves": "solved_by", "enforces": "enforced_by", "violates": "violated_by"}
#: Rows of an id and a path of at most a few ids: tens of megabytes.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts df only if it is seen to hold at most ``rows`` rows; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def inverse_of(rel: F.Column) -> F.Column:
    return F.create_map(*[F.lit(x) for p in INVERSE.items() for x in p])[rel]


def derive_inverses(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with derived inverse edges. Where a target gets derived inverse edges of a relation, they replace stored ones; targets that are no entity get none."""
    ids = entities.select(F.col("id").alias("dst")).distinct()
    forward = edges.filter(F.col("rel").isin(*INVERSE)).join(ids, "dst", "left_semi")
    derived = forward.select(F.col("dst").alias("src"), inverse_of(F.col("rel")).alias("rel"), F.col("src").alias("dst")).distinct()
    stored = edges.filter(F.col("rel").isin(*INVERSE.values())).join(derived.select("src", "rel").distinct(), ["src", "rel"], "left_anti")
    rest = edges.filter(~F.col("rel").isin(*INVERSE.values()))
    return rest.unionByName(stored).unionByName(derived)


def neighbors(edges: DataFrame, node: str, rel: str | None = None) -> DataFrame:
    """Outgoing neighbours: of one relation as stored, of all without repeats."""
    own = edges.filter(F.col("src") == node)
    return own.filter(F.col("rel") == rel).select(F.col("dst").alias("id")) if rel else own.select(F.col("dst").alias("id")).distinct()


def merged_neighbors(canonical: DataFrame, user: DataFrame, node: str) -> DataFrame:
    """Canonical targets, and user edges in both directions."""
    return (
        canonical.filter(F.col("src") == node).select(F.col("dst").alias("id"))
        .union(user.filter(F.col("src") == node).select("dst"))
        .union(user.filter(F.col("dst") == node).select("src"))
        .distinct()
    )


def all_edges(canonical: DataFrame, node: str, user: DataFrame | None = None) -> DataFrame:
    """A node's outgoing edges; with a user layer also that layer's incoming ones."""
    own = canonical.filter(F.col("src") == node)
    return own if user is None else own.unionByName(user.filter((F.col("src") == node) | (F.col("dst") == node))).distinct()


def neighborhood(edges: DataFrame, node: str) -> DataFrame:
    """direction, rel, ids (sorted) of one node."""
    out = edges.filter(F.col("src") == node).select(F.lit("out").alias("direction"), "rel", F.col("dst").alias("id"))
    into = edges.filter(F.col("dst") == node).select(F.lit("in").alias("direction"), "rel", F.col("src").alias("id"))
    return out.unionAll(into).groupBy("direction", "rel").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def labelled(ids: DataFrame, entities: DataFrame) -> DataFrame:
    """Ids with type and title; unknown ids drop out."""
    return ids.join(entities.select("id", "type", "title"), "id")


def chain(edges: DataFrame, start: str, rels: list[str], spark: SparkSession) -> DataFrame:
    """All paths from start that follow exactly the relations, as arrays."""
    paths = spark.createDataFrame([(start, [start])], "at string, path array<string>")
    for r in rels:
        hop = edges.filter(F.col("rel") == r).select("src", "dst")
        paths = hop.join(F.broadcast(paths) if r == rels[0] else paths, F.col("src") == F.col("at")).select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
    return paths.select("path")


def hops(spark: SparkSession, edges: DataFrame, start: str, depth: int, target: str | None = None, written: bool = False) -> DataFrame:
    """(id, depth, path): every node within ``depth`` hops, once, with the least path of its least depth; with a target no further than where it is found.

    The edges are written once for all hops, unless ``written`` says that the caller did so.
    """
    seen = frontier = spark.createDataFrame([(start, 0, [start])], "id string, depth int, path array<string>")
    size = 1
    pairs = edges.select("src", "dst")
    if depth > 1 and not written:
        pairs = checkpointed(spark, pairs)
    for d in range(1, depth + 1):
        near = F.broadcast(frontier) if size <= BROADCAST_ROWS else frontier
        step = pairs.join(near, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        found = step.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti")
        frontier = checkpointed(spark, found.select("id", F.lit(d).alias("depth"), "path"))
        seen = seen.unionByName(frontier)
        size, met = frontier.agg(F.count("*"), F.coalesce(F.max(F.col("id") == F.lit(target)), F.lit(False))).first()
        if not size or met:
            break
    return seen


def shortest_path(spark: SparkSession, edges: DataFrame, entities: DataFrame, source: str, target: str, max_depth: int = 5, written: bool = False) -> DataFrame:
    """At most one row (path, length): a shortest directed path of at most max_depth hops, least by ids; both ends must exist."""
    ends = {r.id for r in entities.filter(F.col("id").isin(source, target)).select("id").collect()}
    if ends != {source, target}:
        return spark.createDataFrame([], "path array<string>, length int")
    return hops(spark, edges, source, max_depth, target, written).filter(F.col("id") == target).select("path", F.col("depth").alias("length"))


def path_edges(paths: DataFrame) -> DataFrame:
    """Consecutive pairs of a path: step, src, dst."""
    pair = F.expr("transform(sequence(1, size(path) - 1), i -> struct(i AS step, path[i - 1] AS src, path[i] AS dst))")
    return paths.filter("size(path) > 1").select(F.inline(pair))


def subgraph(spark: SparkSession, edges: DataFrame, entities: DataFrame, center: str, radius: int = 2) -> DataFrame:
    """Distinct edges walked within ``radius`` hops, between entities only."""
    live = edges.join(entities.select(F.col("id").alias("dst")), "dst", "left_semi")
    inner = hops(spark, live, center, max(0, radius - 1)).select(F.col("id").alias("src"))
    return live.join(small(inner), "src", "left_semi").select("src", "rel", "dst").distinct()


def transitive_enforcements(edges: DataFrame) -> DataFrame:
    """(remedy, smell, law): remedy solves smell, smell violates law, and remedy doesn't enforce law yet."""
    solves = edges.filter("rel = 'solves'").select(F.col("src").alias("remedy"), F.col("dst").alias("smell"))
    violates = edges.filter("rel = 'violates'").select(F.col("src").alias("smell"), F.col("dst").alias("law"))
    enforced = edges.filter("rel = 'enforces'").select(F.col("src").alias("remedy"), F.col("dst").alias("law"))
    return solves.join(violates, "smell").join(enforced, ["remedy", "law"], "left_anti").select("remedy", "smell", "law").distinct()


def contradictions(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, title, target): targets that a node both enforces and violates; the title falls back to Unknown."""
    both = edges.filter("rel = 'enforces'").select("src", "dst").distinct().join(edges.filter("rel = 'violates'").select("src", "dst").distinct(), ["src", "dst"])
    named = both.join(entities.select(F.col("id").alias("src"), "title"), "src", "left")
    return named.select(F.col("src").alias("id"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Unknown")).alias("title"), F.col("dst").alias("target"))


def similar(edges: DataFrame, node: str, threshold: float) -> DataFrame:
    """(id, similarity): Jaccard of relation:target labels with the node's, through an inverted index. Above 0 only nodes sharing a label can qualify; at 0 disjoint ones are kept too."""
    labels = edges.select(F.col("src").alias("id"), F.concat_ws(":", "rel", "dst").alias("label")).distinct()
    own = labels.filter(F.col("id") == node).select("label")
    size = labels.groupBy("id").agg(F.count("*").alias("n"))
    mine = size.filter(F.col("id") == node).select(F.col("n").alias("m"))
    shared = labels.join(small(own), "label").groupBy("id").agg(F.count("*").alias("both"))
    joined = size.join(shared, "id", "inner" if threshold > 0 else "left").join(F.broadcast(mine))  # one row
    score = F.coalesce("both", F.lit(0)) / (F.col("n") + F.col("m") - F.coalesce("both", F.lit(0)))
    return joined.filter(F.col("id") != node).select("id", score.alias("similarity")).filter(F.col("similarity") >= threshold)


def stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each type (key 'type:x') and for the totals."""
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown"))
    types = entities.groupBy(F.concat(F.lit("type:"), kind).alias("key")).agg(F.count("*").cast("double").alias("value"))
    ids = entities.agg(F.count("*").cast("double").alias("entities"))
    links = edges.agg(F.count("*").cast("double").alias("edges"), F.countDistinct("src").cast("double").alias("linked"))
    both = ids.join(links).withColumn("avg_edges", F.when(F.col("entities") > 0, F.col("edges") / F.col("entities")).otherwise(F.lit(0.0)))  # one row each
    return types.unionByName(both.selectExpr("stack(4, 'entities', entities, 'edges', edges, 'linked', linked, 'avg_edges', avg_edges) AS (key, value)"))


def flow(edges: DataFrame, entities: DataFrame, rels: list[str] | None = None) -> DataFrame:
    """(src_type, rel, dst_type, n); edges with a dangling end are skipped."""
    kinds = entities.select("id", "type")
    own = edges.filter(F.col("rel").isin(*rels)) if rels else edges
    a, b = kinds.select(F.col("id").alias("src"), F.col("type").alias("src_type")), kinds.select(F.col("id").alias("dst"), F.col("type").alias("dst_type"))
    return own.join(a, "src").join(b, "dst").groupBy("src_type", "rel", "dst_type").agg(F.count("*").alias("n"))


def tree(entities: DataFrame, order: list[str]) -> DataFrame:
    """(type_rank, label, category, n, first_id): types in the given order, empty categories as uncategorized."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("type"))
    label = F.concat(F.upper(F.substring("type", 1, 1)), F.expr("substring(type, 2)"))
    category = F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorized"))
    return entities.groupBy(rank.cast("int").alias("type_rank"), label.alias("label"), category.alias("category")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def export(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of a full export: edge_id, src, rel, dst, between entities only."""
    live = edges.join(entities.select(F.col("id").alias("dst")), "dst", "left_semi")
    return live.select(F.concat_ws("-", "src", "rel", "dst").alias("edge_id"), "src", "rel", "dst").distinct()


def layered(canonical: DataFrame, user: DataFrame, key: str = "id") -> DataFrame:
    """Union of two layers, the canonical row winning where both have a key."""
    both = canonical.withColumn("layer", F.lit("canonical")).unionByName(user.withColumn("layer", F.lit("user")))
    own = Window.partitionBy(key).orderBy("layer")
    return both.withColumn("_r", F.row_number().over(own)).filter("_r = 1").drop("_r")


def integrity(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(check, n): dangling ends, stored inverses, self-loops, repeated edges, and the largest relation's share in basis points."""
    ids = entities.select("id")
    dangling = lambda c: edges.join(ids, edges[c] == ids["id"], "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"dangling_{c}").alias("check"), "n")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    rel = edges.groupBy("rel").agg(F.count("*").alias("k")).agg(F.floor(F.max("k") * 10000 / F.sum("k")).cast("long").alias("n")).select(F.lit("largest_relation_bp").alias("check"), F.coalesce("n", F.lit(0)).alias("n"))
    return (
        dangling("src").unionAll(dangling("dst"))
        .unionAll(count(edges.filter(F.col("rel").isin(*INVERSE.values())), "stored_inverse"))
        .unionAll(count(edges.filter("src = dst"), "self_loop"))
        .unionAll(count(edges.groupBy("src", "rel", "dst").count().filter("count > 1"), "repeated"))
        .unionAll(rel)
    )


def visible(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "rel", "dst")


def upsert(stored: DataFrame, given: DataFrame, key: str = "id") -> DataFrame:
    """Given rows replace stored rows of their key."""
    return stored.join(given.select(key).distinct(), key, "left_anti").unionByName(given)


def upsert_edges(stored: DataFrame, given: DataFrame, owners: DataFrame) -> DataFrame:
    """Deletes the owners' (id) outgoing edges, then inserts the given ones; repeats are ignored, relations lower-cased."""
    kept = stored.join(owners.select(F.col("id").alias("src")), "src", "left_anti")
    return kept.unionByName(given.withColumn("rel", F.lower("rel"))).distinct()


def remove_entity(entities: DataFrame, edges: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """Without the entity and its edges in both directions."""
    return entities.filter(F.col("id") != node), edges.filter((F.col("src") != node) & (F.col("dst") != node))


def title_lookup(entities: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Entities whose title (or name) holds the text in any case; the first ``limit`` by id."""
    own = F.lower("title").contains(text.lower())
    own = own | F.lower("name").contains(text.lower()) if "name" in entities.columns else own
    return entities.filter(own).orderBy("id").limit(limit)


def entity_export(spark: SparkSession, edges: DataFrame, entities: DataFrame, user_edges: DataFrame, node: str, radius: int = 1) -> DataFrame:
    """Edges around a node for display (edge_id, src, rel, dst): its subgraph, or if it isn't in the canonical graph its user edges."""
    known = not entities.filter(F.col("id") == node).isEmpty()
    own = subgraph(spark, edges, entities, node, radius) if known else all_edges(edges.limit(0), node, user_edges)
    return own.select(F.concat_ws("-", "src", "rel", "dst").alias("edge_id"), "src", "rel", "dst")


def add_relations(edges: DataFrame, given: DataFrame) -> DataFrame:
    """Inserts edges; those that are there already stay as they are."""
    return edges.unionByName(given.select(edges.columns)).distinct()


def remove_relations(edges: DataFrame, given: DataFrame) -> DataFrame:
    return edges.join(given.select("src", "rel", "dst").distinct(), ["src", "rel", "dst"], "left_anti").select(edges.columns)


def merged_stats(canonical: DataFrame, user_entities: DataFrame, user_edges: DataFrame) -> DataFrame:
    """Stats (key, value) of the canonical graph with the user layer's counts added; averages and linked nodes stay the canonical ones."""
    more = user_entities.agg(F.count("*").cast("double").alias("n")).select(F.lit("entities").alias("key"), "n").unionAll(user_edges.agg(F.count("*").cast("double").alias("n")).select(F.lit("edges").alias("key"), "n")).unionAll(user_entities.agg(F.count("*").cast("double").alias("n")).select(F.lit("type:insight").alias("key"), "n"))
    return canonical.withColumnRenamed("value", "n").unionByName(more).groupBy("key").agg(F.sum("n").alias("value"))


def chunk_metadata(chunks: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks with metadata: their entity's type, category and, by relation, the sorted targets."""
    rels = ["solves", "solved_by", "enforces", "violates", "related_to"]
    lists = edges.filter(F.col("rel").isin(*rels)).groupBy("src").agg(*[F.array_sort(F.collect_set(F.when(F.col("rel") == r, F.col("dst")))).alias(r) for r in rels])
    own = entities.select(F.col("id").alias("entity_id"), F.col("type"), "category").join(lists.withColumnRenamed("src", "entity_id"), "entity_id", "left")
    empty = [F.coalesce(r, F.array().cast("array<string>")).alias(r) for r in rels]
    return chunks.join(own, "entity_id", "left").select(*chunks.columns, F.struct("entity_id", "type", "category", *empty).alias("metadata"))
