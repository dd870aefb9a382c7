"""Many texts looked for in many texts, as whole tokens in a row.

Patterns whose size is checked go to the tasks as one automaton that finds all of
them in a single pass over each text.  Larger sets of patterns meet the texts by
one token of each: ids and tokens are joined first, texts only with what is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators.durable import kept

#: Characters of patterns up to which a task holds them as an automaton.
AUTOMATON = 20_000_000


@lru_cache(2)
def _automaton(patterns: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, (text, times) in enumerate(patterns):
        found.add_word(f" {text} ", (k, times))
    found.make_automaton()
    return found


def token_hits(texts: DataFrame, patterns: DataFrame, id_: str, text: str, pattern: str, most: int = AUTOMATON) -> DataFrame:
    """(id, found): how many rows of patterns stand in the texts of an id; ids without any are left out.

    Both columns must hold tokens between single spaces.  Empty and null patterns
    stand in no text; a pattern counts once a text and row of patterns.
    """
    known = patterns.where(F.col(pattern) != "").groupBy(F.col(pattern).alias("__p")).agg(F.count("*").alias("__times"))
    size = known.agg(F.sum(F.length("__p") + 32).alias("n")).first()["n"] or 0
    own = texts.select(F.col(id_), F.col(text).alias("__t"))
    hits = _by_automaton(own, known, id_) if size <= most else _by_token(own, known, id_)
    return hits.groupBy(id_).agg(F.sum("found").alias("found"))


def _by_automaton(texts: DataFrame, known: DataFrame, id_: str) -> DataFrame:
    listed = texts.sparkSession.sparkContext.broadcast(tuple(sorted((r["__p"], r["__times"]) for r in known.collect())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(listed.value) if listed.value else None
        for b in batches:
            found = [sum(n for _, n in {v for _, v in auto.iter(f" {t} ")}) if auto and t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=[id_, "found"])

    kind = texts.schema[id_].dataType.simpleString()
    return texts.mapInArrow(run, f"`{id_}` {kind}, found long").where("found > 0")


def _by_token(texts: DataFrame, known: DataFrame, id_: str) -> DataFrame:
    # the longest token of a pattern stands for it
    longest = F.element_at(F.array_sort(F.split("__p", " "), lambda a, b: F.sign(F.length(b) - F.length(a)).cast("int")), 1)
    known = kept(known.select("__p", "__times", longest.alias("__token"), F.xxhash64("__p").alias("__k")), "patterns")
    rows = kept(texts.where("__t is not null").withColumn("__row", F.monotonically_increasing_id()), "texts")
    tokens = rows.select("__row", F.explode(F.array_distinct(F.split("__t", " "))).alias("__token"))
    met = tokens.join(known.select("__token", "__k"), "__token").select("__row", "__k").distinct()
    both = rows.join(met.groupBy("__row").agg(F.collect_set("__k").alias("__ks")), "__row").select(id_, "__t", F.explode("__ks").alias("__k"))
    stands = F.concat(F.lit(" "), "__t", F.lit(" ")).contains(F.concat(F.lit(" "), "__p", F.lit(" ")))
    return both.join(known.select("__k", "__p", "__times"), "__k").where(stands).select(id_, F.col("__times").alias("found"))
