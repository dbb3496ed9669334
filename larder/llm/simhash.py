"""SimHash near-dedup with bit-sliced comparison."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from larder.llm.bloom import BlockedBloom, filled
from larder.llm.common import Workspace, bounded_batches, join_by_key, read, spread
from larder.llm.components import connected_components

BITS = 64
#: Hashes summed into bit counts at a time.
CHUNK = 1 << 15
#: Fingerprints compared together: numpy's calls cost little against the words they work on.
GATHERED = 1 << 16
#: So many bucket sizes are broadcast at most (16 bytes each).
KNOWN_BUCKETS = 1 << 20


def _hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 (seed 42) of each word shingle, repeats included; words are runs of other bytes than space and \\t-\\r."""
    words = text.lower().split()
    line = b" ".join(words)
    if not words:
        return []
    if len(words) <= shingle:
        return [xxh64_intdigest(line, 42)]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    starts, ends = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    view = memoryview(line)
    return [xxh64_intdigest(view[a:b], 42) for a, b in zip(starts, ends, strict=True)]


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a whole text, A-Z lower-cased; zero without words."""
    return majority(np.array(_hashes(text, shingle), dtype=np.uint64))


def two_fingerprints(text: bytes, shingle: int) -> tuple[int, int]:
    """The fingerprint of the distinct shingles, and a second one of remixed hashes, whose bits differ independently."""
    hashes = np.unique(np.array(_hashes(text, shingle), dtype=np.uint64))
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return majority(hashes), majority(mixed ^ (mixed >> np.uint64(32)))


def fingerprints(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def make(stream):
        for batch in stream:
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            out = np.array([fingerprint(t or b"", shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(out)], ["doc_id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(make, "doc_id long, fp long")


def fingerprint_pairs(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp long, fp2 long) of every row."""

    def make(stream):
        for batch in stream:
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            out = np.array([two_fingerprints(t or b"", shingle) for t in texts], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], ["doc_id", "fp", "fp2"])

    return docs.select(id_col, text_col).mapInArrow(make, "doc_id long, fp long, fp2 long")


def _planes(values: np.ndarray) -> np.ndarray:
    """Vertical store: row b holds bit b of every value, 64 values a word; one spare word at the end."""
    lanes = -(-len(values) // 64) * 64
    bits = np.zeros((BITS, lanes), np.uint8)
    bits[:, : len(values)] = np.unpackbits(values.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return np.concatenate([words, np.zeros((BITS, 1), np.uint64)], axis=1)


def _lanes(mask: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(mask) // 64) * 64, np.uint8)
    padded[: len(mask)] = mask
    return np.packbits(padded, bitorder="little").view(np.uint64)


def close_pairs(values: np.ndarray, cells: np.ndarray, radius: int = 3):
    """Yield (left, right) index arrays of pairs in the same cell that differ in at most ``radius`` bits.

    ``cells`` must be sorted. All pairs at one distance k in the order are compared at once: plane b is XORed with
    itself shifted by k lanes, and the differing lanes are added to carry-save counters, one word for each counter bit.
    A lane whose count exceeds the radius sets a sticky flag; a word of 64 lanes whose flags are all set is abandoned.
    """
    n = len(values)
    if n < 2:
        return
    planes = _planes(values)
    _, first, sizes = np.unique(cells, return_index=True, return_counts=True)
    left_after = np.repeat(first + sizes, sizes) - np.arange(n)  # rows of the cell from here on
    width = max(1, int(radius).bit_length())
    for k in range(1, int(sizes.max())):
        alive = _lanes(left_after > k)
        at = np.flatnonzero(alive)
        alive = alive[at]
        q, r = divmod(k, 64)
        counters = [np.zeros(len(at), np.uint64) for _ in range(width)]
        over = ~alive
        last = planes.shape[1] - 1
        near, far = np.minimum(at + q, last), np.minimum(at + q + 1, last)
        for b in range(BITS):
            other = planes[b, near]
            if r:
                other = (other >> np.uint64(r)) | (planes[b, far] << np.uint64(64 - r))
            carry = planes[b, at] ^ other
            for i in range(width):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            over |= carry
            if radius + 1 < 1 << width:
                over |= _exceeds(counters, radius)
            if b % 8 == 7:
                keep = ~over != 0
                if not keep.all():
                    at, near, far, over = at[keep], near[keep], far[keep], over[keep]
                    counters = [c[keep] for c in counters]
                    if not len(at):
                        break
        if len(at):
            hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            word, lane = np.nonzero(hit)
            left = at[word] * 64 + lane
            yield left, left + k


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter, below its overflow, is above the radius."""
    above = np.zeros_like(counters[0])
    equal = ~above
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            above |= equal & counters[i]
            equal = equal & ~counters[i]
    return above


def fold_pairs(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Union the pairs into ``root`` (index of the smallest row known to be linked), in place."""
    while True:
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if not (low < high).any():
            return
        np.minimum.at(root, high, low)
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root[:] = jump


def segments(radius: int, n: int, bucket: int) -> tuple[int, int]:
    """(segments, agreeing): the fewest agreeing segments that leave a value's bucket ``bucket`` of n random fingerprints.

    Fingerprints within the radius agree in at least segments - radius segments, so any choice finds all of them.
    """
    for agree in range(1, 5):
        if n >> (BITS * agree // (radius + agree)) <= bucket:
            break
    return radius + agree, agree


def link_fingerprints(reps: DataFrame, space: Workspace, radius: int, cell_rows: int, scheme: tuple[int, int] | None = None, second: int | None = None) -> DataFrame:
    """(src, dst) edges that connect every two fingerprints within the radius; reps: (fp long, rep long), fp distinct.

    With ``second`` rows carry another fingerprint (fp2 long), and only pairs count of which those differ in at most
    ``second`` bits. Each row then has an edge to its closest row of smaller rep, for each cell it is in, with the bits
    they are apart in both (apart long); rows that are so met have one to themselves: all rows of any pair are in the
    result.
    ``scheme`` sets (segments, agreeing): with fewer than radius + agreeing segments some pairs never meet.

    The values of each choice of agreeing segments are buckets. A bucket above ``cell_rows`` is split by hash into
    parts, and every two parts meet in a cell of their own: no task holds more than two parts of a bucket at once and
    no pair is missed. The bucket sizes are broadcast if the segments have at most KNOWN_BUCKETS values, whatever the
    rows; else those of hot buckets are, and the others are joined by shuffle.
    """
    n_reps = reps.count()
    parts, agree = scheme or segments(radius, n_reps, 4 * cell_rows)
    bounds = [BITS * i // parts for i in range(parts + 1)]
    masks = [sum((1 << bounds[i + 1]) - (1 << bounds[i]) for i in chosen) for chosen in combinations(range(parts), agree)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    segment = F.array(*[F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("val")) for i, m in enumerate(signed)])
    carried = ["fp", "rep"] + ["fp2"] * (second is not None)
    rows = reps.select(*carried, F.explode(segment).alias("s")).select(*carried, "s.seg", "s.val")
    sizes = rows.groupBy("seg", "val").count().where("count > 1")
    if sum(1 << m.bit_count() for m in masks) <= KNOWN_BUCKETS:
        rows = rows.join(F.broadcast(sizes), ["seg", "val"])
    else:
        sizes = space.write(sizes.withColumn("n", F.col("count")), "sizes")
        rows = join_by_key(rows, sizes, ["seg", "val"], "n", n_reps * len(masks))
    rows = rows.withColumn("g", F.ceil(F.col("count") / F.lit(cell_rows)).cast("int"))
    rows = rows.withColumn("a", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    meets = F.when(F.col("g") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("g") - 1), F.array("a")))
    rows = rows.withColumn("b", F.explode(meets)).select(
        *carried, F.xxhash64("seg", "val", F.least("a", "b"), F.greatest("a", "b")).alias("cell")
    )

    def edges(*columns):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["src", "dst", "apart"][: len(columns)])

    def folded(cell, fp, rep):
        at = np.arange(len(fp))
        for left, right in close_pairs(fp, cell, radius):
            fold_pairs(at, left, right)
        moved = np.flatnonzero(at != np.arange(len(at)))
        yield edges(rep[moved], rep[at[moved]])

    def closest(cell, fp, rep, fp2):
        best, at, met = np.full(len(fp), 2 * BITS + 1), np.arange(len(fp)), np.zeros(len(fp), bool)
        for left, right in close_pairs(fp, cell, radius):
            other = np.bitwise_count(fp2[left] ^ fp2[right])
            apart = np.bitwise_count(fp[left] ^ fp[right]) + other
            near = other <= second
            met[left[near]] = True
            closer = near & (apart < best[right])
            best[right[closer]], at[right[closer]] = apart[closer], left[closer]
        moved = np.flatnonzero(met | (best <= 2 * BITS))
        yield edges(rep[moved], rep[at[moved]], best[moved])

    compare_cells = folded if second is None else closest

    def links(cell, fp, rep, *others):
        order = np.lexsort((rep, cell))
        columns = [x[order] for x in (cell, fp, rep, *others)]
        columns[1] = columns[1].view(np.uint64)
        if others:
            columns[3] = columns[3].view(np.uint64)
        yield from compare_cells(*columns)

    def compare(stream):
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in stream:
            held.append(tuple(batch.column(c).to_numpy() for c in ("cell", *carried)))
            n += batch.num_rows
            if n < GATHERED:
                continue
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last cell may go on in the next batch
            if cut:
                yield from links(*[x[:cut] for x in columns])
            held, n = [tuple(x[cut:] for x in columns)], len(columns[0]) - cut
        if n > 1:
            yield from links(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "src long, dst long" + (second is not None) * ", apart long")


def simhash_classes(
    docs: DataFrame, radius: int = 3, shingle: int = 3, cell_rows: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Fingerprints of the whole text link at ``radius`` or fewer differing bits; component_id is the smallest id reachable
    over links, the row's own included. A null or wordless text has fingerprint zero and links like any other; fewer
    words than ``shingle`` count as one shingle. Equal fingerprints are one node, so copies cost nothing in the
    comparison. Rows that repeat an id share a class if any link does. Rows with a null id get their fingerprint and a
    null component. Other columns are ignored. Empty input: no rows.
    """
    bounded_batches(docs.sparkSession)
    space = Workspace(docs.sparkSession, "simhash")
    made = space.write(fingerprints(docs, shingle, id_col, text_col), "fps")
    known = made.where("doc_id is not null")
    reps = space.write(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    # an id on several rows ties their fingerprints together
    again = known.distinct().groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("n")).where("n > 1")
    tied = known.join(again.select("doc_id"), "doc_id", "left_semi").join(reps, "fp").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    edges = link_fingerprints(reps, space, radius, cell_rows).unionByName(tied)
    classes = connected_components(edges, space, "classes")
    named = reps.join(classes, reps["rep"] == classes["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return made.join(named, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )


def shingle_sets(docs: DataFrame, shingle: int, id_col: str, text_col: str, among: BlockedBloom) -> DataFrame:
    """(doc_id, shingles array<long>): the distinct shingle hashes of the rows whose id's hash the filter holds. Texts
    are not shuffled: the others are passed over where they are read."""
    held = docs.sparkSession.sparkContext.broadcast(among)

    def make(stream):
        for batch in stream:
            batch = batch.filter(pa.array(held.value.holds(batch.column("h").to_numpy().view(np.uint64))))
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            sets = [np.unique(np.array(_hashes(t or b"", shingle), dtype=np.uint64)).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return docs.select(id_col, text_col, F.xxhash64(id_col).alias("h")).mapInArrow(make, "doc_id long, shingles array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose whole sets overlap by ``similarity`` (Jaccard); sets: (doc_id, shingles)."""
    one, two = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(s)) for c, s in (("src", "a"), ("dst", "b")))
    both = pairs.join(one, "src").join(two, "dst")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= F.lit(similarity) * (F.size("a") + F.size("b") - shared)).select("src", "dst")


def mostly_in(sets: DataFrame, among: BlockedBloom, share: float) -> DataFrame:
    """The sets (doc_id, component, shingles) of which at least ``share`` may be in the filter."""
    held = sets.sparkSession.sparkContext.broadcast(among)

    def pick(stream):
        for batch in stream:
            column = batch.column("shingles")
            sizes = np.diff(column.offsets.to_numpy())
            hits = held.value.holds(column.flatten().to_numpy().view(np.uint64))
            found = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=hits, minlength=len(sizes))
            yield batch.filter(pa.array(found + 1e-9 >= share * sizes))

    return sets.select("doc_id", "component", "shingles").mapInArrow(pick, "doc_id long, component long, shingles array<long>")


def prefix_pairs(sets: DataFrame, similarity: float, space: Workspace) -> DataFrame:
    """(src, dst) of different components that may overlap by ``similarity``; sets: (doc_id, component, shingles).

    Only shingles of several components can join any. Sets need them for ``similarity`` of their own size; a filter of
    these shingles passes over most others where they lie. Each remaining set is ordered: first the shingles that only
    its component has, then the others by the number of sets that hold them. Sets alike by s share one of their first
    n - ceil(s * n) + 1 shingles, and behind their first shared one must be enough for the overlap they need. So near
    copies that differ too much, each by words of its own, make no pair. No pair alike by ``similarity`` is missed.
    """
    near_zero = 1e-9
    often = sets.select("component", F.explode("shingles").alias("shingle")).groupBy("shingle")
    often = often.agg(F.count("*").alias("often"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = space.write(often.where("low < high").select("shingle", "often", F.col("often").alias("n")), "mixed")
    some = space.write(mostly_in(sets, filled(mixed.select("shingle"), mixed.count()), similarity), "some")
    held = some.select("doc_id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    total = held.count()
    met = join_by_key(held.withColumnRenamed("n", "size"), mixed, ["shingle"], "n", total)
    ranked = met.groupBy("doc_id", "component", "size").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("ranked"))
    own = F.col("size") - F.size("ranked")
    length = F.col("size") - F.ceil(F.col("size") * similarity - near_zero) + 1 - own
    ranked = ranked.where(length > 0).select("doc_id", "component", F.col("size").alias("n"), own.alias("own"), F.slice("ranked", 1, length.cast("int")).alias("prefix"))
    first = ranked.select("doc_id", "component", "n", "own", F.posexplode("prefix").alias("at", "held"))
    first = first.select("doc_id", "component", "n", (F.col("n") - F.col("own") - F.col("at")).alias("left"), F.col("held.shingle").alias("shingle"))
    one, two = first.alias("one"), first.alias("two")
    enough = F.least("one.left", "two.left") * (1 + similarity) + near_zero >= (F.col("one.n") + F.col("two.n")) * similarity
    meet = (F.col("one.shingle") == F.col("two.shingle")) & (F.col("one.doc_id") < F.col("two.doc_id")) & (F.col("one.component") != F.col("two.component"))
    return one.join(two, meet & enough).select(F.col("one.doc_id").alias("src"), F.col("two.doc_id").alias("dst")).distinct()


def near_duplicate_classes(
    docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 14, second: int = 20, scheme: tuple[int, int] = (10, 2), cell_rows: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, component_id) of texts whose word shingles overlap by ``similarity`` (Jaccard) or more.

    Two SimHash fingerprints are taken of the distinct shingles. Rows of which either agrees in ``scheme`` segments meet
    in a cell, where the bit-sliced comparison finds those within ``radius`` bits, and ``second`` bits of the other
    fingerprint. First each row has its nearest of smaller id verified by whole shingle sets, then the nearest of each
    cell where that could still join two classes: that joins most of a group at a cost linear in its size. Then all rows that met any are compared across classes by an
    exact join on their rarest shingles and verified, so no partner is left out. Texts with both fingerprints equal
    count as equal. A link is missed only where neither fingerprint brings one of its texts near to any other
    (measured recall in the README).

    Null and wordless texts are equal to each other. Rows with a null id are left out; rows that repeat an id are one
    document, of which the smallest text counts. Other columns are ignored. Empty input: no rows.
    """
    bounded_batches(docs.sparkSession)
    space = Workspace(docs.sparkSession, "near")
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    least = fingerprint_pairs(known, shingle, "doc_id", "text").groupBy("doc_id").agg(F.min(F.struct("fp", "fp2")).alias("least"))
    prints = space.write(least.select("doc_id", "least.*"), "fps")
    reps = space.write(prints.groupBy("fp", "fp2").agg(F.min("doc_id").alias("rep")), "reps")

    swapped = reps.select(F.col("fp2").alias("fp"), F.col("fp").alias("fp2"), "rep")
    met = [link_fingerprints(x, space, radius, cell_rows, scheme, second) for x in (reps, swapped)]
    near = space.write(met[0].unionByName(met[1]).groupBy("src", "dst").agg(F.min("apart").alias("apart")), "near")
    ends = near.select("src").distinct()
    ends = space.write(ends, "ends")
    ends = ends.withColumnRenamed("src", "doc_id")
    sets = shingle_sets(known, shingle, "doc_id", "text", filled(ends.select(F.xxhash64("doc_id")), ends.count()))
    sets = space.write(sets.join(ends, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("shingles").alias("shingles")), "sets")

    def classed(links: DataFrame, label: str) -> DataFrame:
        classes = connected_components(links, space, label)
        return reps.join(classes, reps["rep"] == classes["node"], "left").select(*reps.columns, F.coalesce("component", "rep").alias("component"))

    near = near.where("src != dst")
    nearest = near.groupBy("src").agg(F.min(F.struct("apart", "dst")).alias("to")).select("src", "to.dst")
    links = space.write(_similar(nearest, sets, similarity), "links")
    # of the other pairs only those that could still join two classes
    firsts = classed(links, "first").select("rep", "component")
    one, two = (firsts.select(F.col("rep").alias(c), F.col("component").alias(n)) for c, n in (("src", "a"), ("dst", "b")))
    open_ = space.write(near.join(one, "src").join(two, "dst").where("a != b").select("src", "dst"), "open")
    links = links.unionByName(space.write(_similar(open_, sets, similarity), "more"))
    seconds = classed(links, "second").select(F.col("rep").alias("doc_id"), "component")
    placed = space.write(sets.join(seconds, "doc_id"), "placed")
    rest = space.write(prefix_pairs(placed, similarity, space), "rest")
    links = links.unionByName(space.write(_similar(rest, sets, similarity), "last"))
    named = classed(links, "classes").select("fp", "fp2", F.col("component").alias("component_id"))
    return prints.join(named, ["fp", "fp2"]).select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near-duplicate class, and rows without an id."""
    classes = near_duplicate_classes(docs, id_col=id_col, **options)
    gone = classes.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op10_simhash(spark, sf_dir):
    return simhash_classes(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))
