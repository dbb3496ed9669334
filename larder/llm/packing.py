"""Packing token sequences with minimum bin slack."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from larder.llm.bpe import byte_symbols
from larder.llm.common import Workspace, bounded_batches, read, spread

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one thread

#: How a byte-level vocabulary splits text into words, numbers, signs and white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What only the vocabulary's own library encodes: letters beyond Latin and white space other than the space and the line
#: end, where the Unicode tables of the two libraries could differ; what may be a special token; very long words.
OTHERS = re.compile("[\u0250-\U0010ffff\t\x0b-\r\x1c-\x1f\x85\xa0]|<\\||[^ \n]{1000}")


def same_by_rank(file: dict) -> tiktoken.Encoding | None:
    """The vocabulary for the library that merges by token rank, in half the time; None unless the file says that the
    results agree: PATTERN is how it splits, nothing else is done to a text, each merge makes a new token, and tokens
    are numbered in the order of the merges, after the bytes."""
    model, before = file["model"], file["pre_tokenizer"] or {}
    plain = file["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    plain &= model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    symbols, vocab = byte_symbols(), model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    left = len(vocab) - len(made)
    special = {x["content"] for x in file.get("added_tokens", ())}
    plain &= all(a < b for a, b in zip(made, made[1:], strict=False)) and all(vocab.get(s, left) < made[0] for s in symbols)
    plain &= all("<|" in x for x in special)  # as OTHERS takes for granted
    if not plain or left != len(symbols) + len(special.intersection(vocab)):
        return None
    byte_of = {s: b for b, s in enumerate(symbols)}
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("latin", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class ByteBpe:
    """A byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_rank = same_by_rank(json.load(f))

    def encode(self, texts: list[str], together: int = 256) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        out: list[bytes] = [b""] * len(texts)
        others = []
        for i, text in enumerate(texts):
            if self.by_rank is None or OTHERS.search(text):
                others.append(i)
            elif text:
                out[i] = array("I", self.by_rank.encode_ordinary(text)).tobytes()
        for at in range(0, len(others), together):
            part = others[at : at + together]
            for i, found in zip(part, self.library.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(found.ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def slack(fill: int, capacity: int) -> int:
    """Padding of a window: to the capacity, none at a power of two."""
    return 0 if fill & (fill - 1) == 0 else capacity - fill


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of remaining lengths, the longest one included, that leaves the least slack; fuller if equal.

    Bitset subset sums: bit s of a set says that s can be filled. A length with count c enters by doubling shifts. The
    sets are kept, and the counts are read off backwards from the best sum.
    """
    longest = max(counts)
    room = capacity - longest
    lengths = sorted((n for n in counts if n <= room and counts[n] > (n == longest)), reverse=True)
    full = (1 << (room + 1)) - 1
    sets = [1]
    for n in lengths:
        if sets[-1] >> room & 1:
            break
        bits, left, step = sets[-1], min(counts[n] - (n == longest), room // n), 1
        while left:
            take = min(step, left)
            bits |= bits << (take * n) & full
            left -= take
            step *= 2
        sets.append(bits)
    best = min((s for s in range(room + 1) if sets[-1] >> s & 1), key=lambda s: (slack(longest + s, capacity), -s))
    chosen = {longest: 1}
    for i in range(len(sets) - 1, 0, -1):
        n, used = lengths[i - 1], 0
        while not sets[i - 1] >> best & 1:
            best -= n
            used += 1
        if used:
            chosen[n] = chosen.get(n, 0) + used
    return chosen


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(multiset, times) until nothing remains: each filling is repeated as often as the counts allow.

    The work depends on the number of different lengths, at most ``capacity``, not on the number of rows.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    plan = []
    while left:
        chosen = fill_window(left, capacity)
        times = min(left[n] // k for n, k in chosen.items())
        plan.append((chosen, times))
        for n, k in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return plan


class Placement:
    """Where the r-th piece of each length goes: per length, segments of ranks that fill windows of one kind."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        segments: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        base = 0
        for chosen, times in plan:
            offset = 0
            for n, k in sorted(chosen.items(), reverse=True):
                segments.setdefault(n, []).append((used.get(n, 0), k, base, offset))
                used[n] = used.get(n, 0) + k * times
                offset += n * k
            base += times
        self.segments = {n: np.array(x, np.int64) for n, x in segments.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            start, copies, base, first = self.segments[int(n)].T
            i = np.searchsorted(start, rank[at], side="right") - 1
            local = rank[at] - start[i]
            sequence[at] = base[i] + local // copies[i]
            offset[at] = first[i] + local % copies[i] * n
        return sequence, offset


PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: the columns of ``keep``, id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``. It is cut into windows of ``capacity`` and a remainder; the remainders are
    packed by minimum bin slack. Only the histogram of lengths (at most ``capacity`` rows) reaches the driver, and the
    plan for it is as small; pieces find their place by their rank within their length, which partial counts per task
    give without a sort or a hot group. Sequence ids are gapless from 0.

    Null text counts as empty: one piece of one id. Rows with equal or null ids are documents of their own. ``keep``
    names further input columns to carry along. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    space = Workspace(docs.sparkSession, "packing")
    spare = {c: f"__keep_{i}" for i, c in enumerate(keep)}
    schema = T.StructType([
        *[T.StructField(spare[c], docs.schema[c].dataType) for c in keep],
        T.StructField("__id", T.LongType()),
        *[T.StructField(f"__{c}", T.LongType()) for c in ("start", "length", "crc", "total", "task", "local")],
    ])
    names = schema.names

    def cut(stream):
        bpe, task = byte_bpe(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = int(end_id).to_bytes(4, "little")
        for whole in stream:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows: list[int] = []
                out: list[list[int]] = [[], [], [], []]
                for i, ids in enumerate(bpe.encode([t or "" for t in batch.column("__text").to_pylist()])):
                    ids = memoryview(ids + end)
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        rows.append(i)
                        for values, x in zip(out, (start, len(piece) // 4, zlib.crc32(piece), total), strict=True):
                            values.append(x)
                length = np.array(out[1], np.int64)
                local = np.zeros(len(length), np.int64)
                for n in np.unique(length):
                    here = np.flatnonzero(length == n)
                    local[here] = seen[n] + np.arange(len(here))
                    seen[n] += len(here)
                carried = batch.select(names[: len(keep) + 1]).take(pa.array(rows, pa.int64()))
                columns = [carried.column(i) for i in range(len(keep) + 1)]
                columns += [pa.array(out[0], pa.int64()), pa.array(length), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())]
                columns += [pa.array(np.full(len(rows), task, np.int64)), pa.array(local)]
                yield pa.RecordBatch.from_arrays(columns, names)

    given = docs.select(*[F.col(c).alias(spare[c]) for c in keep], F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    pieces = space.write(given.mapInArrow(cut, schema), "pieces")
    # at most ``capacity`` short rows a task, so a file a core: a JVM that makes a local file may fork, and so double for a moment
    counts = pieces.groupBy("__length", "__task").agg(F.count("*").alias("n")).coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    counts = space.write(counts, "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("__length").agg(F.sum("n")).collect()}
    placement = Placement(plan_windows(histogram, capacity))
    earlier = Window.partitionBy("__length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__length", "__task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__first"))
    ranked = pieces.join(starts, ["__length", "__task"]).select(*names[: len(keep) + 5], (F.col("__first") + F.col("__local")).alias("__rank"))
    fields = [*docs.select(*keep).schema.fields, *T._parse_datatype_string(f"{id_col} long, {PIECE}, sequence_id long, offset long").fields]
    final = T.StructType(fields)
    named = final.names

    def put(stream):
        for batch in stream:
            length, rank = (batch.column(c).to_numpy() for c in ("__length", "__rank"))
            sequence, offset = placement.place(length, rank)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], named)

    return ranked.mapInArrow(put, final)


def op3_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(spread(read(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))
