"""Language ID by Bayesian evidence fusion."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Workspace, bounded_batches, join_by_key, read, spread

#: Hashed letter trigrams.
BUCKETS = 1 << 15
#: Scores are whole units of 1/UNIT nats, so that sums do not depend on their order.
UNIT = 1024
#: Labelled rows the text model is fitted on (expected number); so it tells at most as many languages apart.
TRAIN_ROWS = 3000
#: A text's trigrams depend on each other: together they count as at most this many independent ones.
EFFECTIVE = 60
#: Pseudo-counts with which a host leans on its domain, a domain on its suffix, a suffix on everything.
LEAN = 20.0
#: Chance that a declaration is off, before the table has shown its own.
WRONG = 0.1

NOT_LETTER = re.compile(r"[\W\d_]+")
SKIPPED = re.compile(r"(?is)<!--.*?(?:-->|$)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|$)")
TAG = re.compile(r"<[^>]*>?")
#: An html tag reaches to the next angle bracket, and blanks are never given back: linear whatever the page.
HTML_TAG = re.compile(r"(?i)<html\b([^<>]*)")
LANG = re.compile(r"(?i)\blang\s*+=\s*+[\"']?\s*+([a-z]{2,8})")


def declared_language(page: str) -> str | None:
    """What the first html element with a lang attribute declares."""
    return next((m[1] for tag in HTML_TAG.finditer(page) if (m := LANG.search(tag[1]))), None)


def trigrams(text: str) -> np.ndarray:
    """Bucket of each letter trigram: words in lower case with a blank on either side."""
    letters = NOT_LETTER.sub(" ", text.lower()).strip()
    if not letters:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    mixed = codes[:-2] * np.uint64(0x9E3779B1) ^ codes[1:-1] * np.uint64(0x85EBCA77) ^ codes[2:] * np.uint64(0xC2B2AE3D)
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)


def _fit(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages of a labelled sample (text, label) and their trigram scores, BUCKETS rows.

    Counts are added up by (label, bucket) on the executors; the driver gets one row for each such pair that occurs.
    """

    def count(stream):
        totals: dict[str, np.ndarray] = {}
        for batch in stream:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                totals.setdefault(label, np.zeros(BUCKETS, np.int64))
                totals[label] += np.bincount(trigrams(text or ""), minlength=BUCKETS)
        for label, held in totals.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at), pa.array(held[at])], ["label", "bucket", "n"])

    summed = sample.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = summed.column("label").to_pylist()
    languages = sorted(set(names))
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.int32)
    place = {x: i for i, x in enumerate(languages)}
    counts = np.full((BUCKETS, len(languages)), 0.05)
    np.add.at(counts, (summed.column("bucket").to_numpy(), [place[x] for x in names]), summed.column("n").to_numpy())
    scores = np.log(counts / counts.sum(axis=0))
    return languages, np.rint((scores - scores.max(axis=1, keepdims=True)) * UNIT).astype(np.int32)


def labelled_sample(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of about TRAIN_ROWS labelled rows, the same ones in each run: those whose hashed id lies below the
    share that so many rows are of all. Whole texts; no sort, and no task gathers the sample."""
    given = docs.select(F.col(text_col).alias("text"), F.lower(F.col(label_col)).alias("label"), F.xxhash64(id_col).alias("h")).where("label <> ''")
    n = given.select("label").count()
    if n > TRAIN_ROWS:
        given = given.where(F.col("h") < F.lit(int((TRAIN_ROWS / n - 0.5) * 2.0**64)).cast("long"))
    return given.select("text", "label")


def fuse(rows: DataFrame, sample: DataFrame, markup: bool = False, min_posterior: float = 0.5) -> DataFrame:
    """Name the language of each row; rows: (id, text, declared, host), other columns are carried along.

    Evidence, added up as logarithms:
    - the text: naive Bayes over letter trigrams, fitted on ``sample`` (text, label); it counts as at most EFFECTIVE
      trigrams;
    - the declared language: how often other rows that declare it read as each language, counted over all rows;
    - the address: how often the host's other rows read as each language, leaning on the registered domain (last two
      labels), that on the address suffix (last label), that on all rows. These counts are grouped aggregates over all
      rows; a hot host costs each task one partial row, and its priors are broadcast.

    A row's own reading is taken out of all counts it is judged by: it already speaks as text.

    With ``markup`` the text is a page: scripts, styles and tags are left out, and the ``lang`` of its html element is
    the declaration when the column is null.

    Adds text_lang, lang, posterior (double, 6 decimals) and accepted; they replace columns of these names. A row
    without letters has no text evidence and is rejected (lang is still the likeliest by the rest); so is a row whose
    best language stays below ``min_posterior``. Equal scores go to the alphabetically first language. Null texts,
    declarations and hosts are no evidence. If the sample has no labels, nothing can be told: lang is null and every
    row with letters is accepted. Rows may repeat, ids may be null; empty tables are fine.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    space = Workspace(spark, "langid")
    languages, scores = _fit(sample)
    n_lang = len(languages)
    rows = rows.drop("text_lang", "lang", "posterior", "accepted")
    other = [c for c in rows.columns if c not in ("text", "declared", "host")]

    def read_text(stream):
        for batch in stream:
            texts, declared = batch.column("text").to_pylist(), batch.column("declared").to_pylist()
            heard, told, sizes = [], [], []
            for text, said in zip(texts, declared, strict=True):
                text = text or ""
                if markup:
                    if said is None:
                        said = declared_language(text)
                    text = html.unescape(TAG.sub(" ", SKIPPED.sub(" ", text)))
                codes = trigrams(text)
                total = scores[codes].sum(axis=0, dtype=np.int64) if n_lang else np.zeros(0, np.int64)
                heard.append((total * min(EFFECTIVE, len(codes)) // max(1, len(codes))).tolist())
                told.append(re.split("[-_]", said.strip().lower())[0] or None if said else None)
                sizes.append(len(codes))
            columns = [batch.column(c) for c in other] + [batch.column("host")]
            columns += [pa.array(told, pa.string()), pa.array(heard, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*other, "__host", "__told", "__heard", "__n"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*other).schema.fields)
    heard = rows.mapInArrow(read_text, f"{names + ', ' if names else ''}__host string, __told string, __heard array<bigint>, __n bigint")
    languages_col = F.array(*[F.lit(x) for x in languages]).cast("array<string>")
    if not n_lang:
        return heard.select(
            *other, F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), (F.col("__n") > 0).alias("accepted")
        )
    # the language that the text alone reads as, from 1; 0 for none
    first = F.when(F.col("__n") > 0, F.array_position("__heard", F.array_max("__heard")).cast("int")).otherwise(0)
    heard = space.write(heard.withColumn("__first", first), "heard")

    tally = lambda: F.array(*[F.count_if(F.col("__first") == i + 1) for i in range(n_lang)])
    add = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(n_lang)])
    mix = lambda own, base: F.transform(F.arrays_zip(own.alias("n"), base.alias("p")), lambda x: (x["n"] + x["p"] * LEAN))
    part = lambda c: F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda s, y: s + y))
    to_units = lambda c: F.transform(c, lambda p: F.floor(F.log(p) * UNIT))
    own = F.col("__first")
    others = lambda c: F.transform(c, lambda x, i: x - F.when(i + 1 == own, 1).otherwise(0))

    totals = heard.agg(tally().alias("n"), F.count("*").alias("rows")).first()
    everywhere = F.array(*[F.lit(int(x)) for x in totals["n"]])
    overall = part(F.transform(others(everywhere), lambda x: x + F.lit(1.0)))
    #: Each key that has been read, with the readings that its rows have: what they are judged by, without themselves.
    readings = lambda n: F.filter(F.sequence(F.lit(0), F.lit(n_lang)), lambda i: (i == 0) | (F.element_at(n, F.greatest(i, F.lit(1))) > 0))

    hosts = heard.where("__host is not null").groupBy("__host").agg(tally().alias("n"), F.count("*").alias("rows"))
    hosts = hosts.withColumn("domain", F.substring_index("__host", ".", -2)).withColumn("suffix", F.substring_index("__host", ".", -1))
    hosts = space.write(hosts, "hosts")
    domains = space.write(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), add("n").alias("dn"), F.count("*").alias("n_hosts")), "domains")
    suffixes = domains.groupBy("suffix").agg(add("dn").alias("sn"), F.count("*").alias("n_domains"))
    domains = space.write(join_by_key(domains, space.write(suffixes, "suffixes"), ["suffix"], "n_domains", domains.count(), "left"), "placed")
    placed = join_by_key(hosts, domains.drop("suffix"), ["domain"], "n_hosts", hosts.count(), "left")
    each = placed.withColumn("__first", F.explode(readings(F.col("n"))))
    prior = overall
    for level in ("sn", "dn", "n"):
        each = each.withColumn("p", part(mix(others(F.col(level)), prior)))
        prior = F.col("p")
    held = F.when(own == 0, F.col("rows") - F.aggregate("n", F.lit(0).cast("bigint"), lambda s, x: s + x)).otherwise(F.element_at("n", F.greatest(own, F.lit(1))))
    priors = space.write(each.select("__host", "__first", held.alias("held"), to_units(F.col("p")).alias("__prior")), "priors")

    # P(declared | language), smoothed towards declarations that are right; a declaration outside the languages says nothing
    said = heard.where(F.col("__told").isin(languages) & (own > 0)).groupBy("__told").agg(tally().alias("n"))
    said = said.withColumn("__first", F.explode(readings(F.col("n"))))
    guess = F.transform(languages_col, lambda x: F.when(x == F.col("__told"), 1 - WRONG).otherwise(WRONG / max(1, n_lang - 1)))
    each_said = F.transform(
        F.arrays_zip(others(F.col("n")).alias("n"), guess.alias("g"), others(everywhere).alias("all")), lambda x: F.floor(F.log((x["n"] + x["g"] * LEAN) / (x["all"] + LEAN)) * UNIT)
    )
    said = said.select("__told", "__first", each_said.alias("__said"))  # at most languages x (languages + 1) rows
    none = F.array(*[F.lit(0)] * n_lang)
    joined = join_by_key(heard, priors, ["__host", "__first"], "held", totals["rows"], "left").join(F.broadcast(said), ["__told", "__first"], "left")
    default = to_units(overall)
    total = F.transform(
        F.arrays_zip(F.col("__heard").alias("a"), F.coalesce("__prior", default).alias("b"), F.coalesce("__said", none.cast("array<bigint>")).alias("c")),
        lambda x: x["a"] + x["b"] + x["c"],
    )
    scored = joined.withColumn("__total", total).withColumn("__best", F.array_max("__total"))
    weight = F.aggregate("__total", F.lit(0.0), lambda s, x: s + F.exp((x - F.col("__best")) / UNIT))
    at = lambda i: F.element_at(languages_col, i.cast("int"))
    return scored.select(
        *other,
        F.when(own > 0, at(own)).alias("text_lang"),
        at(F.array_position("__total", F.col("__best"))).alias("lang"),
        F.round(1 / weight, 6).alias("posterior"),
        ((F.col("__n") > 0) & (1 / weight >= min_posterior)).alias("accepted"),
    )


def url_host(url):
    """Host column of a URL: after ``://`` up to ``/ ? #``, without user and port, lower case; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def op1_language_id(spark, sf_dir):
    pages = spread(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    rows = pages.select("page_id", F.col("html").alias("text"), F.lit(None).cast("string").alias("declared"), url_host(F.col("url")).alias("host"))
    return fuse(rows, labelled_sample(read(spark, sf_dir, "documents")), markup=True)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language the fused evidence names, with that language as their ``lang``.

    ``lang`` is the declaration, ``source`` the host. Rows that share an id go together, and only if all are rejected;
    of several languages they get the alphabetically first. Rows without an id stay as they are.
    """
    space = Workspace(docs.sparkSession, "identified")
    rows = docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("lang").alias("was"), F.lower("source").alias("host"))
    judged = fuse(rows, labelled_sample(docs)).where("doc_id is not null").groupBy("doc_id")
    judged = judged.agg(F.max("accepted").alias("__accepted"), F.min("lang").alias("__lang"), F.bool_and(F.col("was").eqNullSafe(F.col("lang"))).alias("same"))
    # only what changes: few rows, that Spark broadcasts if they are small as written
    changed = space.write(judged.where("not __accepted or not same").select(F.col("doc_id").alias("__id"), "__accepted", "__lang"), "changed")
    met = docs.join(changed, F.col("doc_id") == F.col("__id"), "left").where(F.coalesce("__accepted", F.lit(True)))
    return met.withColumn("lang", F.coalesce("__lang", "lang")).select(*docs.columns)
