"""Line dedup, SimHash, BPE, packing, license scan: contracts against SQL, libraries or brute force, and odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larder.llm import bpe, license_scan, line_dedup, packing, simhash
from larder.llm.common import Workspace, join_by_key

from .helpers import SF, docs, jaccard_classes, oracle, same, words

LONG = "A line that is long enough to count here."


def odd_rows():
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, f"{LONG}\nx"), (5, f" \t{LONG.upper()}\r\nx"), (6, f"{LONG}\n{LONG}\nlast"), (7, "short\nshort"), (None, f"{LONG}\ny"), (8, LONG + "é"), (9, "é" * 19), (10, "é" * 19)]
    rows += [(6, f"{LONG}\nagain"), (11, words(rng, 30_000)), (12, "x" * 200_000)]
    return rows


def test_line_dedup_sql(spark):
    same(line_dedup.op6_line_dedup(spark, SF), oracle(line_dedup.OP6_SQL))


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup_odd(spark, batches, fanout):
    df = docs(spark, odd_rows())
    got = line_dedup.drop_repeated_lines(df, batches=batches, fanout=fanout).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
    same(got, oracle(line_dedup.OP6_SQL, documents=df.toPandas().astype({"doc_id": "Int64"})))


def test_line_dedup_names_and_empty(spark):
    df = docs(spark, [(1, f"{LONG}\na"), (2, LONG), (3, LONG)]).withColumns({"n_lines": F.lit("mine"), "h": F.lit(1), "batch": F.lit(2), "top": F.lit(3)})
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got[1].text == "a" and (got[1].n_lines, got[1].n_dropped, got[1].h) == (2, 1, 1) and got[2].text == "" and got[3].text == LONG
    assert line_dedup.drop_repeated_lines(docs(spark, []).limit(0)).count() == 0


def test_line_runs_are_neither_shuffled_nor_sorted_again(spark):
    space = Workspace(spark, "runs")
    runs = line_dedup.LineRuns(space, 3)
    entries = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("h"), (F.col("id") % 5).alias("n"), F.col("id").alias("top"))
    entries = entries.groupBy("h").agg(F.max("n").alias("n"), F.max("top").alias("top"))
    runs.absorb(entries)
    with runs.ordered():
        plan = runs.against(entries)._jdf.queryExecution().executedPlan().toString()
        # both belong to the batch
        assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Bucketed: true" in plan
    assert runs.against(entries).count() == entries.where("n < 3").count()
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("larder_run")]


def test_join_by_key(spark):
    rows = spark.createDataFrame([(1 if i % 3 else (None if i % 2 else i), i) for i in range(5000)], "k long, v long")
    table = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("w"))
    for how in ("inner", "left"):
        got = sorted(map(repr, join_by_key(rows, table, ["k"], "n", 200_000, how).collect()))
        assert got == sorted(map(repr, rows.join(table.drop("n"), ["k"], how).collect()))


def brute_simhash(text, shingle):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    if not w:
        return 0
    parts = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, fps, radius):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if ids[a] == ids[b] or (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius,shingle,cell", [(3, 3, 512), (3, 3, 2), (7, 5, 4), (0, 3, 512)])
def test_simhash(spark, radius, shingle, cell):
    rng = random.Random(3)
    base = words(rng, 300).split()
    rows = odd_rows()[:-2] + [(13, "one two"), (14, "ONE two"), (15, words(rng, 20_000))]
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(300)] = "zz"
        rows.append((100 + i, " ".join(w)))
    df = docs(spark, rows).withColumn("fp", F.lit("clash"))
    got = simhash.simhash_classes(df, radius=radius, shingle=shingle, cell_rows=cell).collect()
    fps = [brute_simhash(t, shingle) for i, t in rows]
    known = [(i, f) for (i, _), f in zip(rows, fps, strict=True) if i is not None]
    want = classes([i for i, _ in known], [f for _, f in known], radius)
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == sorted((repr(i), f"{f:016x}", repr(want.get(i))) for (i, _), f in zip(rows, fps, strict=True))


def test_simhash_whole_table_and_empty(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fps = [brute_simhash(t, 3) for _, t in rows]
    want = classes([i for i, _ in rows], fps, 3)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op10_simhash(spark, SF).collect()} == {(i, f"{f:016x}", want[i]) for (i, _), f in zip(rows, fps, strict=True)}
    assert simhash.simhash_classes(docs(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 7, 10])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    for n in (1, 2, 64, 65, 300):
        v = rng.integers(0, 2**63, 4, dtype=np.uint64)[rng.integers(0, 4, n)]
        for i in range(n):
            for b in rng.integers(0, 64, rng.integers(0, radius + 3)):
                v[i] ^= np.uint64(1) << np.uint64(b)
        cells = np.sort(rng.integers(0, 3, n))
        got = {p for a, b in simhash.close_pairs(v, cells, radius) for p in zip(a.tolist(), b.tolist(), strict=True)}
        assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if cells[i] == cells[j] and int(v[i] ^ v[j]).bit_count() <= radius}


def test_keep_one_of_each(spark):
    df = docs(spark, [(5, "a b c d"), (3, "A b c d"), (4, "other words of its own"), (None, "a b c d")])
    assert {r.doc_id for r in simhash.keep_one_of_each(df).collect()} == {3, 4, None}


ODD_TEXTS = [
    None, "", "  ", "a" * 600, "aaaa aaa aaaaaaaaa", "Σίσυφος ΣΑΣ", "İstanbul ß ẞ", "foo<|endoftext|>bar <|startoftext|>", "日本語 한국어", "a\x1cb c\x1fd", "a\xa0b\u3000c\x85d", "🙂🙂 👩‍👩‍👧", "it's we're I'LL 'S",
    "1234567890 ½ Ⅷ", " a", "a ", "\n", "a\n\nb", "a \nb", "a\n b", "tab\tbed", "x  y", "\x00\x01", "<|", "word " * 20_000,
]


def random_texts(seed, n):
    rng = random.Random(seed)
    alphabet = "aábcABC's ñü1 2,.!?-\n\tΣσ中🙂\u0301İ\xa0"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50))) for _ in range(n)]


def test_word_bpe(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = list(enumerate([*ODD_TEXTS, *random_texts(1, 400)])) + [(0, "again"), (None, "no id")]
    got = bpe.encode_documents(docs(spark, rows).withColumn("ids", F.lit(1)), public_tokenizers.path("word_bpe_49k.json")).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((repr(i), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted((repr(r.doc_id), bytes(r.ids), r.decoded) for r in got) == sorted(want)
    assert bpe.encode_documents(docs(spark, []).limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_word_bpe_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in bpe.op9_bpe(spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_automaton_small():
    """Merges over two letters, doubled letters included, against plain merging in rank order."""
    rng = random.Random(4)
    for _ in range(30):
        symbols = ["a", "b"]
        merges, vocab = [], {s: i for i, s in enumerate(["a", "b", "a.", "b."])}
        pool = list(vocab)
        while len(merges) < 12:
            u, v = rng.choice(pool), rng.choice(pool)
            if u.endswith(".") or u + v in vocab:
                continue
            merges.append((u, v))
            vocab[u + v] = len(vocab)
            pool.append(u + v)
        machine = bpe.MergeAutomaton(vocab, merges, symbols, ".")
        machine.inner, machine.final = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for s in symbols:
            machine.inner[ord(s)], machine.final[ord(s)] = vocab[s], vocab[s + "."]
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(60)]
        for text, ids in zip(texts, machine.encode_words([t.encode() for t in texts]), strict=True):
            parts = [*text[:-1], text[-1] + "."]
            for u, v in merges:
                i = 0
                while i + 1 < len(parts):
                    if parts[i] == u and parts[i + 1] == v:
                        parts[i : i + 2] = [u + v]
                    i += 1
            assert np.frombuffer(ids, "<u4").tolist() == [vocab[p] for p in parts] == np.frombuffer(machine.encode_long(text.encode()), "<u4").tolist()


def test_byte_bpe():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for t in ODD_TEXTS] + random_texts(2, 3000)
    got = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def check_pieces(rows, texts, capacity=1024):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts), key=len)
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sum(r.length for r in rows) == sum(len(w) // 4 for w in want)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += packing.slack(at, capacity)
    assert set(windows) == set(range(len(windows)))
    return by_doc, padding


def test_packing_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.op3_packing(spark, SF).collect()
    by_doc, padding = check_pieces(rows, list(texts.values()))
    assert padding < 0.02 * sum(r.length for r in rows)
    for (doc, total), parts in by_doc.items():
        ids, at = np.array([*library.encode(texts[doc], add_special_tokens=False).ids, 0], "<u4"), 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids) == total
    assert {d for d, _ in by_doc} == set(texts)


def test_packing_counts_in_few_files(spark, monkeypatch):
    """However many partitions a shuffle has, the small table of counts is a file a core at most."""
    partitions = {}
    write = Workspace.write

    def counted(self, df, name):
        out = write(self, df, name)
        partitions[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(Workspace, "write", counted)
    held = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = docs(spark, [(n, " ".join(["word"] * n)) for n in range(300)])
        assert packing.pack_documents(rows, public_tokenizers.path("byte_bpe_50k.json")).count() == 300
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < partitions["counts"] <= spark.sparkContext.defaultParallelism


def test_packing_odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "x"), (1, "again and again")]
    df = docs(spark, rows).withColumns({"__id": F.lit(9), "length": F.lit("mine")})
    got = packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json"), keep=("lang",))
    assert got.columns[:2] == ["lang", "doc_id"]
    check_pieces(got.collect(), [t for _, t in rows])
    assert packing.pack_documents(docs(spark, []).limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_windows_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 32): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        chosen = packing.fill_window(counts, 32)
        assert all(counts[n] >= k for n, k in chosen.items()) and max(counts) in chosen
        items = [n for n, c in counts.items() for _ in range(c)]
        items.remove(max(counts))
        sums = {max(counts)}
        for n in items:
            sums |= {s + n for s in sums if s + n <= 32}
        fill = sum(n * k for n, k in chosen.items())
        assert (packing.slack(fill, 32), -fill) == min((packing.slack(s, 32), -s) for s in sums)
        plan = packing.plan_windows(counts, 32)
        assert {n: sum(p.get(n, 0) * t for p, t in plan) for n in counts} == counts


MIT = """Copyright 2020 X

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software.

The above copyright notice and this permission notice shall be included in all
copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. More."""


def test_license_sql(spark):
    same(license_scan.op4_license_scan(spark, SF), oracle(license_scan.OP4_SQL))


def test_license_odd(spark):
    rows = [(1, MIT), (2, None), (3, ""), (4, "Released under the MIT\nLicense."), (5, "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0"), (6, "Licence of no kind."), (5, MIT), (None, MIT)]
    rows += [(7, "plain words. " * 30_000 + "Released under the MIT License."), (8, "All rights reserved. " * 3)]
    df = docs(spark, rows).withColumns({"low": F.lit(1), "tags": F.lit(2), "licenses": F.lit(3)})
    same(license_scan.scan_licenses(df), oracle(license_scan.OP4_SQL, documents=df.toPandas().astype({"doc_id": "Int64"})))
    got = {r.doc_id: (r.licenses, r.unmatched, r.n_sentences) for r in license_scan.scan_licenses(df).where("doc_id <> 5").collect()}
    assert got[1] == ("MIT", "", 3) and got[4] == ("MIT", "", 1) and got[7] == ("MIT", "", 1) and got[8] == ("", "<Rights>" * 3, 3) and got[2] == ("", "", 0)
    assert license_scan.scan_licenses(docs(spark, []).limit(0)).count() == 0
    assert all(word in pattern for _, word, pattern in license_scan.SENTENCES)


NOTICE = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public\nLicense as published by the Free Software Foundation; {2}."
#: Texts as they stand in source files, and the name each license has.
NOTICES = [
    (NOTICE.format("library", "Lesser ", "either version 2.1 of the License, or (at your option) any later version"), "LGPL-2.1-or-later"),
    (NOTICE.format("library", "Lesser ", "version 2.1 of the License only"), "LGPL-2.1-only"),
    (NOTICE.format("library", "Library ", "either version 2 of the License, or (at your option) any later version"), "LGPL-2.0-or-later"),
    (NOTICE.format("library", "Lesser ", "either version 3 of the License, or (at your option) any later version"), "LGPL-3.0-or-later"),
    (NOTICE.format("library", "Lesser ", "version 3 of the License"), "LGPL-3.0-only"),
    (NOTICE.format("program", "Affero ", "either version 3 of the License, or (at your option) any later version"), "AGPL-3.0-or-later"),
    (NOTICE.format("program", "Affero ", "version 3"), "AGPL-3.0-only"),
    (NOTICE.format("program", "", "either version 3 of the License, or\n(at your option) any later version"), "GPL-3.0-or-later"),
    (NOTICE.format("program", "", "version 2 of the License, or any later version"), "GPL-2.0-or-later"),
    (NOTICE.format("program", "", "version 2"), "GPL-2.0-only"),
    ("// SPDX-License-Identifier: MIT", "MIT"), ("SPDX-License-Identifier: GPL-2.0-or-later\ncode here", "GPL-2.0-or-later"), ("# SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1-only"),
    ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"), ("SPDX-License-Identifier: ISC.", "ISC"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
     'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.', "ISC"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy.", "Unlicense"),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "BSL-1.0"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at x.", "EPL-2.0"),
    ("All rights reserved. This program is made available under the terms of the Eclipse Public License v1.0 which accompanies it", "EPL-1.0"),
    (MIT, "MIT"), ("This code is licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Available under the MIT License.", "MIT"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
    ("The license plate was blue. He gave his permission.", ""), ("The general public bought a license in version 3.", ""), ("SPDX-License-Identifier: NONE", ""),
]


#: Denied licenses, SPDX expressions, short forms and full texts; the names are written down by hand.
MORE_NOTICES = [
    ("This project is not licensed under the MIT License.", ""), ("The data is no longer available under the MIT License", ""), ("This isn't released under the MIT license.", ""),
    ("Not distributed under the terms of the GNU General Public License version 2.", ""), ("You may not distribute this software under the Apache License, Version 2.0.", ""),
    ("This is not licensed under the MIT License but under the Apache License, Version 2.0.", "Apache-2.0"), ("This is licensed under the MIT license and not under the GNU General Public License, version 2.", "MIT"),
    ("It may not be distributed except under the terms of the GNU General Public License, version 2.", "GPL-2.0-only"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT,Apache-2.0"), ("// SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR ISC\nint main;", "MIT,BSD-3-Clause,ISC"),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only WITH Classpath-exception-2.0"), ("/* SPDX-License-Identifier: GPL-2.0 */", "GPL-2.0-only"), ("SPDX-License-Identifier: LGPL-2.1+", "LGPL-2.1-or-later"),
    ("SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note OR MIT", "GPL-2.0-only WITH Linux-syscall-note,MIT"), ("SPDX-License-Identifier: LicenseRef-mine OR MIT", "MIT"),
    ("# SPDX-License-Identifier: MIT\n# SPDX-License-Identifier: CC-BY-NC-ND-4.0", "MIT,CC-BY-NC-ND-4.0"), ("SPDX-License-Identifier: MIT\nReleased under the ISC license.", "ISC,MIT"), ("SPDX-License-Identifier:", ""),
    ("SPDX-License-Identifier: mit", "MIT"), ("SPDX-License-Identifier: GPL-2.0-only WITH Nothing-known", "GPL-2.0-only"),
    ("License: MIT", "MIT"), ("Licensed under the GPLv3", "GPL-3.0-only"), ("License: GPLv3+", "GPL-3.0-or-later"), ("GNU GPL, version 3", "GPL-3.0-only"), ("Licensed under the LGPL v2.1 or later.", "LGPL-2.1-or-later"), ("License: AGPL-3.0-only", "AGPL-3.0-only"),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it.", "Zlib"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"), ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC-BY-NC-ND-4.0"), ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
    ("Creative Commons Attribution-ShareAlike 3.0 Unported", "CC-BY-SA-3.0"), ("                                 Apache License\n                           Version 2.0, January 2004", "Apache-2.0"), ("License: Apache-2.0", "Apache-2.0"),
    ("Licensed under the 3-clause BSD license", "BSD-3-Clause"), ("License: BSD-2-Clause", "BSD-2-Clause"), ("MIT License\n\nCopyright (c) 2020", "MIT"), ("A licensed plumber is not available under the bridge.", ""),
]


def test_license_denials_and_expressions(spark):
    rows = [(i, t) for i, (t, _) in enumerate(MORE_NOTICES)]
    rows += [(900, "SPDX-License-Identifier: " + "MIT OR " * 200_000 + "ISC"), (901, "license not " + "be " * 300_000 + "licensed under x"), (902, "license not licensed under " * 20_000)]
    rows += [(903, "see license " * 50_000), (904, "gnu general public license version 2 any " * 20_000), (905, "license " + "." * 500_000 + "x"), (906, "license" + "!" * 500_000)]
    df = docs(spark, rows)
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(df).collect()}
    assert {t: got[i] for i, (t, _) in enumerate(MORE_NOTICES)} == dict(MORE_NOTICES)
    assert [got[i] for i in (900, 901, 902, 903, 904, 905, 906)] == ["MIT,ISC", "", "", "", "GPL-2.0-only", "", ""]
    few = docs(spark, rows[: len(MORE_NOTICES)])
    same(license_scan.scan_licenses(few), oracle(license_scan.OP4_SQL, documents=few.toPandas().astype({"doc_id": "Int64"})))


def test_license_names(spark):
    got = license_scan.scan_licenses(docs(spark, [(i, t) for i, (t, _) in enumerate(NOTICES)])).collect()
    assert {r.doc_id: r.licenses for r in got} == {i: name for i, (_, name) in enumerate(NOTICES)}


def test_near_duplicates(spark):
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "x" * 100_000)]
    for g in range(12):
        base = words(rng, 200).split()
        for k in range(5):
            w = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 12))):
                w[rng.randrange(200)] = words(rng, 1, "xyz")
            rows.append((100 * g + 10 + k, " ".join(w)))
    df = docs(spark, [*rows, (None, "no id"), (4, "one")]).withColumns({"fp": F.lit(1), "rep": F.lit(2)})
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(df).collect()}
    want = jaccard_classes(rows, 5, 0.8)
    assert set(got) == set(want)
    assert sum(got[i] == want[i] for i in want) >= 0.93 * len(want)
    # a class is never wider than the brute-force one
    assert all(want[got[i]] == want[i] for i in want)
    assert simhash.near_duplicate_classes(docs(spark, []).limit(0)).count() == 0


def test_near_duplicates_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = jaccard_classes(rows, 5, 0.8)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(docs(spark, rows)).collect()}
    gone, known = {i for i in want if want[i] < i}, {i for i in got if got[i] < i}
    assert known <= gone and len(known) >= 0.9 * len(gone)


def test_prefix_pairs_miss_none(spark):
    rng = random.Random(3)
    sets = {}
    for g in range(8):
        base = [rng.getrandbits(62) for _ in range(rng.choice((1, 5, 35, 60)))]
        for k in range(8):
            changed = rng.sample(range(len(base)), rng.randrange(1 + len(base) // 5))
            sets[10 * g + k] = sorted({rng.getrandbits(62) if i in changed else x for i, x in enumerate(base)})
    sets[99] = []
    rows = [(i, i % 3, s) for i, s in sets.items()]
    df = spark.createDataFrame(rows, "doc_id long, component long, shingles array<long>")
    got = {(r.src, r.dst) for r in simhash.prefix_pairs(df, 0.8, Workspace(spark, "a")).collect()}
    both = [(a, b, set(sets[a]), set(sets[b])) for a in sets for b in sets if a < b and a % 3 != b % 3]
    want = {(a, b) for a, b, x, y in both if x and y and 5 * len(x & y) >= 4 * len(x | y)}
    assert want and want <= got
    assert all(a % 3 != b % 3 for a, b in got)
    assert simhash.prefix_pairs(df.limit(0), 0.8, Workspace(spark, "b")).count() == 0
