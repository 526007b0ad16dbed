"""Texts against many terms: which terms stand in a text as a substring, without comparing all with all.

A lexicon whose counted bytes stay under a bound is sent to the workers, each
of which compiles it once into an automaton that finds all terms in one pass
over a text. A larger one stays a table: each of its terms is indexed by the
one of its grams that is rarest among the texts, texts meet terms by gram, and
a substring test decides. Terms shorter than a gram always take the automaton;
their number is bounded by the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import checkpointed

#: Bytes and terms up to which a lexicon is sent to the workers; length of a gram.
MOST_BYTES, MOST_TERMS, GRAM = 32 << 20, 2_000_000, 3

_compiled: dict[object, ahocorasick.Automaton] = {}


def automaton(terms: list[str], key: object) -> ahocorasick.Automaton:
    """Compiled once a worker; the last one is kept."""
    if key not in _compiled:
        a = ahocorasick.Automaton()
        for t in terms:
            a.add_word(t, t)
        a.make_automaton()
        _compiled.clear()
        _compiled[key] = a
    return _compiled[key]


def _scanned(texts: DataFrame, terms: list[str], text_col: str) -> DataFrame:
    """One pass over each text with the automaton of terms."""
    if not terms:
        return texts.drop(text_col).withColumn("term", F.lit("")).filter("false")
    shared, key = texts.sparkSession.sparkContext.broadcast(terms), hash(tuple(terms))
    kept = [c for c in texts.columns if c != text_col]
    place, places = texts.columns.index(text_col), [texts.columns.index(c) for c in kept]
    schema = texts.select(*kept).withColumn("term", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(shared.value, key)
        for b in batches:
            rows, out = [], []
            for k, text in enumerate(b.column(place)):
                if own := {t for _, t in found.iter(text.as_py() or "")}:
                    rows += [k] * len(own)
                    out += sorted(own)
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([*(b.column(k).take(at) for k in places), pa.array(out, pa.string())], [*kept, "term"])

    return texts.mapInArrow(run, schema)


def grams(text: F.Column) -> F.Column:
    """Distinct grams of a text that has at least one."""
    at = F.sequence(F.lit(1), F.char_length(text) - (GRAM - 1))
    return F.when(F.char_length(text) >= GRAM, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM)))))


def _met(texts: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """Texts and terms meet by each term's rarest gram."""
    spark = texts.sparkSession
    own = terms.select("term", F.explode(grams(F.col("term"))).alias("gram"))
    each = texts.select(F.explode(grams(F.col(text_col))).alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi")
    often = each.groupBy("gram").agg(F.count("*").alias("n"))
    rare = own.join(often, "gram").groupBy("term").agg(F.count("*").alias("have"), F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    chosen = checkpointed(spark, rare.filter(F.col("have") == F.size(grams(F.col("term")))).select("gram", "term"))  # a gram that no text has rules its term out
    kept = [c for c in texts.columns if c != text_col]
    number = texts.withColumn("_text", F.col(text_col)).select(*kept, "_text", F.explode(grams(F.col(text_col))).alias("gram"))
    return number.join(chosen, "gram").filter(F.contains("_text", F.col("term"))).select(*kept, "term")


def contained(texts: DataFrame, terms: DataFrame, text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(the texts' other columns, term) for every text and term (each once) that it contains; texts are taken as they are."""
    spark = texts.sparkSession
    lexicon = checkpointed(spark, terms.select(F.col("term").cast("string").alias("term")).filter("term <> ''").distinct())
    size = lexicon.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    collected = lambda df: sorted(r.term for r in df.collect())
    if size.bytes <= most_bytes and size.n <= MOST_TERMS:
        return _scanned(texts, collected(lexicon), text_col)
    short = F.char_length("term") < GRAM
    return _scanned(texts, collected(lexicon.filter(short)), text_col).unionByName(_met(texts, lexicon.filter(~short), text_col))
