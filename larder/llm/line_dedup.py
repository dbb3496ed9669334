"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from larder.llm.common import Workspace, bounded_batches, join_by_key, read

#: Stripped at both ends of a line: space and \t \n \v \f \r.
BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the stripped line with A-Z lower-cased; None below ``min_chars`` code points."""
    key = line.strip(BLANKS)
    if len(key) < min_chars:
        return None
    if not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxh3_128_digest(key.lower())


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    return (x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist())


class LineRuns:
    """Levelled sorted runs: each entry is a line hash, in how many documents it was seen, and the largest of them.

    Batches must come in descending document order. A new batch is merge-anti-joined with the entries of the runs that
    have reached ``min_docs``: their fate and their keeper are settled, so the batch adds nothing to them. What is left
    is written as a run of its own. Once a level holds ``fanout`` runs they are merged into one run of the next level,
    counts added up.

    Runs are tables bucketed and sorted by hash, one file a bucket, so that their side of each join and merge is neither
    shuffled nor sorted again. They are dropped by close().
    """

    ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"

    def __init__(self, space: Workspace, min_docs: int, fanout: int = 2):
        self.space, self.spark, self.min_docs, self.fanout = space, space.spark, min_docs, fanout
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.held: set[str] = set()

    @contextmanager
    def ordered(self) -> Iterator[None]:
        """What is planned here takes the runs as sorted."""
        was = self.spark.conf.get(self.ORDERED)
        self.spark.conf.set(self.ORDERED, "true")
        try:
            yield
        finally:
            self.spark.conf.set(self.ORDERED, was)

    def _write(self, entries: DataFrame) -> str:
        name = f"larder_run_{uuid.uuid4().hex}"
        with self.ordered():
            entries.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", self.space.path(name)).saveAsTable(name)
        self.held.add(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.space.drop(name)
        self.held.discard(name)

    def _added(self, one: str, two: str) -> DataFrame:
        a, b = (self.spark.table(x).select("h", F.col("n").alias(f"n{i}"), F.col("top").alias(f"top{i}")) for i, x in enumerate((one, two)))
        added = F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))
        return a.join(b.hint("merge"), "h", "full").select("h", added.alias("n"), F.greatest("top0", "top1").alias("top"))

    def _merge(self, one: str, two: str) -> str:
        name = self._write(self._added(one, two))
        self._drop(one)
        self._drop(two)
        return name

    def against(self, entries: DataFrame) -> DataFrame:
        """The entries that no run has settled."""
        for run in [x for level in self.levels for x in level]:
            settled = self.spark.table(run).where(F.col("n") >= self.min_docs).select("h")
            entries = entries.join(settled.hint("merge"), "h", "left_anti")
        return entries

    def absorb(self, entries: DataFrame) -> None:
        """entries: (h, n, top) of a batch whose documents are all smaller than those of earlier batches."""
        self.levels[0].append(self._write(self.against(entries)))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                merged = reduce(self._merge, self.levels[level])
                self.levels[level] = []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)

    def condemned(self) -> DataFrame:
        """(h, n, top) of lines seen in at least ``min_docs`` documents; top is the document that keeps them."""
        *middle, last = [x for level in reversed(self.levels) for x in level]
        entries = self._added(reduce(self._merge, middle), last) if middle else self.spark.table(last)
        return entries.where(F.col("n") >= self.min_docs)

    def close(self) -> None:
        for name in list(self.held):
            self._drop(name)


def drop_repeated_lines(
    docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 3, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Drop lines that many documents share, except in the largest document holding them.

    A text is split at \\n. A line's key is the line without white space at its ends, A-Z lower-cased; keys of at least
    ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except in the largest id
    holding them. Returns the input columns with the text replaced, and n_lines (before dropping) and n_dropped (long).

    The batches are ranges of ids with about as many rows each. A line that many documents hold costs each task one
    partial row in the runs; where its documents are looked up, its hash is broadcast.

    Null or empty text: one empty line, kept. Rows with a null id are kept whole and lend no line to others. Rows that
    repeat an id count as one document, each is returned. Input columns named n_lines or n_dropped are replaced. Works
    on whole texts; memory is one Arrow batch, and the lines of one document. Empty input: no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    space = Workspace(spark, "lines")
    docs = docs.drop("n_lines", "n_dropped")

    def extract(stream):
        for batch in stream:
            ids, hashes = [], []
            for doc, text in zip(batch.column("id").to_pylist(), _texts(batch, "text"), strict=True):
                found = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
                ids += [doc] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["doc_id", "h"])

    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    kept_schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    lines = space.write(known.where("text is not null").mapInArrow(extract, "doc_id long, h binary"), "lines")
    total = lines.count()
    if not total:
        hits = spark.createDataFrame([], "__id long, __hits array<binary>")
    else:
        repeated = not known.groupBy("id").count().where("count > 1").isEmpty()
        seen = F.count_distinct("doc_id") if repeated else F.count("*")  # without repeated ids a task's partial counts add up
        cuts = known.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
        bounds = [None, *sorted(set(cuts)), None]
        runs = LineRuns(space, min_docs, fanout)
        try:
            for low, high in reversed(list(pairwise(bounds))):
                batch = lines if low is None else lines.where(F.col("doc_id") > low)
                batch = batch if high is None else batch.where(F.col("doc_id") <= high)
                runs.absorb(batch.groupBy("h").agg(seen.alias("n"), F.max("doc_id").alias("top")))
            with runs.ordered():  # far fewer rows than lines
                condemned = space.write(runs.condemned().coalesce(max(1, runs.buckets // 8)), "condemned")
        finally:
            runs.close()
        met = join_by_key(lines, condemned, ["h"], "n", total).where(F.col("doc_id") < F.col("top"))
        hits = met.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("h").alias("__hits"))
    names = docs.columns
    at = names.index(text_col)

    def rewrite(stream):
        for batch in stream:
            texts, counts, drops = [], [], []
            for text, hit in zip(_texts(batch, text_col), batch.column("__hits").to_pylist(), strict=True):
                parts = text.split(b"\n")
                if hit:
                    gone = set(hit)
                    left = [x for x in parts if line_key(x, min_chars) not in gone]
                    text = b"\n".join(left)
                else:
                    left = parts
                texts.append(text)
                counts.append(len(parts))
                drops.append(len(parts) - len(left))
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            columns += [pa.array(counts, pa.int64()), pa.array(drops, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_dropped"])

    has_id = F.col(id_col).isNotNull()
    joined = docs.where(has_id).join(hits, F.col(id_col) == F.col("__id"), "left").drop("__id")
    joined = joined.unionByName(docs.where(~has_id).withColumn("__hits", F.lit(None).cast("array<binary>")))  # these need no shuffle
    return joined.mapInArrow(rewrite, kept_schema)


def op6_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = """
WITH lines AS (
  SELECT row_id, doc_id, ord, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_id, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS ord
        FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), keys AS (
  SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 20 AND doc_id IS NOT NULL
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, coalesce(l.doc_id < k.top, false) AS gone FROM lines l LEFT JOIN keys k ON l.key = k.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_id
"""
