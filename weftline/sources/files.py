"""Sources and sinks of knowledge: JSON graphs, markdown, chunk and edge tables, key-value metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.sources import versions

#: Prefixes of ids that load, and the relations that a stored entity may carry.
PREFIXES = ["DP-", "RF-", "LAW-", "SMELL-"]
ENTITY = "id string, type string, title string, description string, name string, category string, tags array<string>, relations map<string,array<string>>, context map<string,array<string>>, file_path string"
TYPES = {"DP": "pattern", "RF": "refactoring", "LAW": "law", "SMELL": "smell", "TK": "insight"}


def json_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and stored edges of a JSON file that is one object keyed by id; other keys and malformed entities are skipped, the key is the id, missing fields are empty."""
    raw = spark.read.option("wholetext", "true").text(path)
    each = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "body"))
    ok = F.exists(F.array(*map(F.lit, PREFIXES)), lambda p: F.startswith(F.col("id"), p))
    e = each.filter(ok).select("id", F.from_json("body", ENTITY).alias("e")).filter("e is not null")
    blank = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit(""))
    kind = F.create_map(*[F.lit(x) for p in TYPES.items() for x in p])[F.regexp_extract("id", "^([A-Z]+)-", 1)]
    entities = e.select("id", F.coalesce(F.nullif(F.lower(F.col("e.type")), F.lit("")), kind).alias("type"), blank("title").alias("title"), blank("description").alias("description"), blank("name").alias("name"), blank("category").alias("category"), F.coalesce("e.tags", F.array().cast("array<string>")).alias("tags"), F.col("e.context").alias("context"), blank("file_path").alias("file_path"))
    edges = e.select(F.col("id").alias("src"), F.explode("e.relations").alias("rel", "ids")).select("src", "rel", F.explode("ids").alias("dst"))
    return entities, edges


def load_graph(spark: SparkSession, json_path: str, entity_table: str | None = None, edge_table: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The tables if both exist, else the JSON file; inverse edges derived."""
    if entity_table and edge_table and spark.catalog.tableExists(entity_table) and spark.catalog.tableExists(edge_table):
        e, x = graph_tables(spark.table(entity_table), spark.table(edge_table))
    else:
        e, x = json_graph(spark, json_path)
    return e, graph.derive_inverses(x, e)


def graph_tables(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of known types, and edges whose two ends are loaded."""
    e = entities.filter(F.lower("type").isin(*TYPES.values())).withColumn("type", F.lower("type"))
    return e, graph.visible(edges, e)


def first_section(text: F.Column) -> F.Column:
    """The first paragraph under the first '## ' heading: up to a blank line after text or another heading, lines trimmed and joined by a blank."""
    after = F.regexp_extract(text, r"(?s)(?:^|\n)## [^\n]*\n(.*)", 1)
    until = F.regexp_extract(after, r"(?s)^\s*((?:(?!\n\s*\n|\n?#).)*)", 1)
    return F.array_join(F.filter(F.transform(F.split(until, "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of markdown files; README files and /ko/ folders are skipped."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("wholetext", "true").text(path)
    return d.select(F.input_file_name().alias("path"), F.col("value").alias("text")).filter(~F.contains("path", F.lit("README")) & ~F.contains("path", F.lit("/ko/")))


def write_chunks(chunks: DataFrame, path: str, replace: str = "id", writer: tuple[str, int] | None = None) -> int:
    """Insert or replace by id in a table kept by version; chunks without the table's columns are an error and change nothing."""
    return versions.upsert(chunks, path, replace, writer)


def write_graph(entities: DataFrame, edges: DataFrame, path: str, writer: tuple[str, int] | None = None) -> None:
    """Entities by id and edges by their three columns, in two tables kept by version under a path."""
    versions.upsert(entities, f"{path}/entities", "id", writer)
    versions.upsert(edges.select("src", F.lower("rel").alias("rel"), "dst"), f"{path}/edges", ["src", "rel", "dst"], writer)


def embed_missing(chunks: DataFrame, path: str, dim: int = 384, writer: tuple[str, int] | None = None) -> int:
    """Embeds the chunks (id, text) that the table of vectors at a path does not have yet."""
    new = chunks.select("id", "text")
    if versions.current(chunks.sparkSession, path)["schema"] is not None:  # else all are missing, and texts stay where they are
        new = missing_embeddings(new, versions.read(chunks.sparkSession, path))
    new = embed(new, dim=dim)
    return versions.append(new.select("id", "embedding"), path, "id", writer)


def _chunked(files_: DataFrame) -> DataFrame:
    """Chunks with type and title; texts are shuffled to be numbered only if an entity has several rows."""
    from weftline.operators import retrieval

    if files_.groupBy("entity_id").count().filter("count > 1").isEmpty():
        return retrieval.chunk_markdown_rows(files_.filter("entity_id IS NOT NULL"))
    return retrieval.chunk_markdown(files_.select("entity_id", "text")).join(files_.select("entity_id", "entity_type", "title"), "entity_id")


def build(spark: SparkSession, files_: DataFrame, entities: DataFrame, edges: DataFrame, path: str, run: int, dim: int = 384) -> DataFrame:
    """The build pipeline: markdown (entity_id, entity_type, title, text) to chunks, the graph, vectors of chunks that have none, and what was built as metadata (key, value). A repeated run of the same number changes nothing that stands."""
    write_chunks(_chunked(files_.select("entity_id", "entity_type", "title", "text")), f"{path}/chunks", writer=("build", run))
    write_graph(entities, edges, path, ("build", run))
    chunks = versions.read(spark, f"{path}/chunks")
    embed_missing(chunks, f"{path}/vectors", dim, ("build", run))
    counts = {"chunks": "chunks", "entities": "entities", "edges": "edges", "embedded": "vectors"}
    totals = [versions.read(spark, f"{path}/{t}").agg(F.lit(k).alias("key"), F.count("*").cast("string").alias("value")) for k, t in counts.items()]
    totals.append(chunks.agg(F.lit("files").alias("key"), F.countDistinct("entity_id").cast("string").alias("value")))
    totals.append(spark.createDataFrame([("dimension", str(dim))], "key string, value string"))
    versions.upsert(reduce(DataFrame.unionByName, totals), f"{path}/metadata", "key", ("build", run), 1)
    return versions.read(spark, f"{path}/metadata")


def missing_embeddings(chunks: DataFrame, embedded: DataFrame, id_col: str = "id") -> DataFrame:
    """Chunks without a vector."""
    return chunks.join(embedded.select(id_col), id_col, "left_anti")


def hashed(texts: pd.Series, dim: int) -> list[np.ndarray]:
    """The offline default of an embedding model: hashed bags of tokens, of unit length; a text without tokens is a zero vector."""
    out = []
    for text in texts:
        tokens = re.sub(r"[^\w\s]|_", " ", (text or "").lower()).split()
        slots = np.fromiter((xxhash.xxh64_intdigest(t) % dim for t in tokens), np.int64, len(tokens))
        counts = np.bincount(slots, minlength=dim).astype(np.float64)
        norm = np.sqrt((counts * counts).sum())
        out.append((counts / norm if norm else counts).astype(np.float32))
    return out


def embed(texts: DataFrame, text_col: str = "text", dim: int = 384, load=None) -> DataFrame:
    """The rows with an ``embedding`` of a text column.

    ``load()`` is called once a worker's task and returns a model: a function of
    a list of texts that gives as many vectors. Texts for which the model raises
    or gives another length get a zero vector. Without it, tokens are counted
    into hashed slots, at a cost that does not depend on the dimension.
    """

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load() if load else lambda x: hashed(x, dim)
        for part in parts:
            try:
                found = list(model(part.tolist()))
            except Exception:  # one bad text must not cost the others their vectors
                found = [_one(model, t) for t in part.tolist()]
            yield pd.Series([v if v is not None and len(v) == dim else np.zeros(dim, np.float32) for v in found])

    return texts.withColumn("embedding", run(F.col(text_col)))


def _one(model, text):
    try:
        return model([text])[0]
    except Exception:
        return None


def set_metadata(meta: DataFrame, key: str, value: str) -> DataFrame:
    """Upserts one pair of a (key, value) table."""
    return meta.filter(F.col("key") != key).unionByName(meta.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def model_mismatch(meta: DataFrame, model: str, dim: int) -> DataFrame:
    """Rows of the stored model settings that differ from those configured."""
    want = meta.sparkSession.createDataFrame([("model", model), ("dimension", str(dim))], "key string, wanted string")
    return meta.join(want, "key").filter("value <> wanted")
