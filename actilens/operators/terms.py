"""Search for many terms in texts: a multi-pattern automaton in every task, over a dictionary that is a table.

A dictionary whose bytes are counted to be at most ``SHARD_BYTES`` is broadcast, and texts go past it where they stand. A
larger one is dealt into shards of about that size by a hash of the term. Each text is sent to every shard, where a task
builds one automaton from the terms that come first and lets its texts go past; the hits of a row meet under the row's
number. The number of terms is not bounded, and they are never part of the plan.

Terms are found as ``contains`` finds them: plain substrings, the empty term in every text, nothing in a null text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actilens.session import cut_lineage

SHARD_BYTES = 4 << 20
HITS = "array<struct<label:string,term:string>>"


class Terms:
    """Finds which of some (label, term) entries lie in a text."""

    def __init__(self, labels: Sequence[str | None], terms: Sequence[str]):
        import ahocorasick

        self.entries = pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(terms, pa.string())], ["label", "term"])
        places: dict[str, list[int]] = {}
        for place, term in enumerate(terms):
            places.setdefault(term, []).append(place)
        self.always = places.pop("", [])
        self.automaton = ahocorasick.Automaton()
        for term, where in places.items():
            self.automaton.add_word(term, tuple(where))
        self.automaton.make_automaton()
        self.some = bool(places)

    def places(self, text: str | None) -> list[int]:
        """Places of the entries inside a text."""
        if text is None:
            return []
        found = {where for _, where in self.automaton.iter(text)} if self.some else ()
        return [*self.always, *(place for where in found for place in where)]

    def hits(self, texts: pa.Array) -> pa.Array:
        """The entries inside each text, as a list of structs a text."""
        found = [self.places(t) for t in texts.to_pylist()]
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        every = pa.array([place for places in found for place in places], pa.int64())
        return pa.ListArray.from_arrays(pa.array(offsets), self.entries.take(every))


def with_terms(texts: DataFrame, column: str, terms: DataFrame, name: str = "hits", shard_bytes: int | None = None) -> DataFrame:
    """``texts`` with the entries of ``terms`` (``label``, ``term``) inside ``column``, as array ``name`` of structs."""
    shard_bytes = shard_bytes or SHARD_BYTES
    entries = cut_lineage(terms.select(F.col("label").cast("string"), "term").where("term is not null").distinct())
    size = entries.agg(F.sum(F.octet_length("term") + F.coalesce(F.octet_length("label"), F.lit(0)))).first()[0] or 0
    if size > shard_bytes:
        return _sharded(texts, column, entries, name, -(-size // shard_bytes))
    rows = entries.toArrow()
    shared = texts.sparkSession.sparkContext.broadcast((rows.column("label").to_pylist(), rows.column("term").to_pylist()))

    @F.arrow_udf(HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = Terms(*shared.value)
        for batch in batches:
            yield found.hits(batch)

    return texts.withColumn(name, hits(F.col(column)))


def _sharded(texts: DataFrame, column: str, entries: DataFrame, name: str, shards: int) -> DataFrame:
    spark = texts.sparkSession
    # Several tasks share the texts of a shard; each gets all terms of it.
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    numbered = cut_lineage(texts.withColumn("_row", F.monotonically_increasing_id()))
    task = lambda shard, salt: (shard * salts + salt).cast("int").alias("task")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lines = numbered.where(F.col(column).isNotNull()).select("_row", F.col(column).alias("text"), every(shards).alias("shard"))
    lines = lines.select("_row", F.lit(None).cast("string").alias("label"), "text", task(F.col("shard"), F.pmod(F.xxhash64("_row"), F.lit(salts))))
    words = entries.select("label", "term", every(salts).alias("salt"))
    words = words.select(
        F.lit(-1).cast("long").alias("_row"), "label", F.col("term").alias("text"), task(F.pmod(F.xxhash64("term"), F.lit(shards)), F.col("salt"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, terms, now, found = [], [], None, None
        for batch in batches:
            rows, of = batch.column("_row").to_numpy(), batch.column("task").to_numpy()
            # Runs of one task's terms or of its texts.
            cuts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | ((rows[1:] < 0) != (rows[:-1] < 0)), [True]]))
            for begin, end in zip(cuts.tolist(), cuts[1:].tolist()):
                part = batch.slice(begin, end - begin)
                if of[begin] != now:
                    labels, terms, now, found = [], [], of[begin], None
                if rows[begin] < 0:
                    labels += part.column("label").to_pylist()
                    terms += part.column("text").to_pylist()
                    continue
                found = found or Terms(labels, terms)
                hits = found.hits(part.column("text"))
                row = np.repeat(rows[begin:end], np.diff(hits.offsets.to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array(row), *hits.values.flatten()], ["_row", "label", "term"])

    dealt = lines.unionByName(words).repartitionById(shards * salts, F.col("task")).sortWithinPartitions("task", "_row")
    found = dealt.mapInArrow(run, "_row long, label string, term string")
    per_row = found.groupBy("_row").agg(F.collect_list(F.struct("label", "term")).alias(name))
    hits = F.coalesce(name, F.array().cast(HITS)).alias(name)
    return numbered.join(per_row, "_row", "left").select(*texts.columns, hits)
