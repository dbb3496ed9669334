"""License scans by sentence-rule recognition, DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import read

#: Identifiers that an SPDX line may name, besides the families below.
SPDX = (
    "0BSD AFL-3.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 CC0-1.0 "
    "CDDL-1.0 CDDL-1.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 ISC JSON MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA OFL-1.0 OFL-1.1 OpenSSL "
    "PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib"
).split()
EXCEPTIONS = (
    "Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0 Font-exception-2.0 GCC-exception-2.0 GCC-exception-3.1 "
    "Libtool-exception Linux-syscall-note LLVM-exception OCaml-LGPL-linking-exception OpenJDK-assembly-exception-1.0 Qt-GPL-exception-1.0 WxWindows-exception-3.1"
).split()
GNU_VERSIONS = [("GPL", "1.0"), ("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "1.0"), ("AGPL", "3.0"), ("GFDL", "1.1"), ("GFDL", "1.2"), ("GFDL", "1.3")]
#: Elements of the Creative Commons licenses and how their titles say them.
CC_KINDS = [
    ("BY", "attribution"), ("BY-SA", "attribution[ -]share ?alike"), ("BY-NC", "attribution[ -]non-?commercial"), ("BY-NC-SA", "attribution[ -]non-?commercial[ -]share ?alike"),
    ("BY-ND", "attribution[ -]no-?deriv(ative)?s"), ("BY-NC-ND", "attribution[ -]non-?commercial[ -]no-?deriv(ative)?s"),
]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]


def _spdx_names() -> dict[str, str]:
    """Name of each identifier in lower case; a plain GNU version, as older lines have it, means that version only."""
    plain = SPDX + [f"CC-{kind}-{v}" for kind, _ in CC_KINDS for v in CC_VERSIONS]
    names = {x.lower(): x for x in plain} | {x.lower() + "+": x + "+" for x in plain}
    for family, v in GNU_VERSIONS:
        only, later = f"{family}-{v}-only", f"{family}-{v}-or-later"
        names |= {f"{family}-{v}".lower(): only, only.lower(): only, f"{family}-{v}+".lower(): later, later.lower(): later}
    return names


SPDX_NAMES = _spdx_names()
EXCEPTION_NAMES = {x.lower(): x for x in EXCEPTIONS}
SPDX_LINE = "spdx-license-identifier "

#: What stands before the version in a notice of the GNU family, and how it says that later ones do as well.
_GNU = {"LGPL": "gnu (lesser|library) general public license", "AGPL": "gnu affero general public license", "GPL": "gnu general public license"}
_LATER = r"(or|any) .*later"
_UNDER = r"(under|license|gnu|terms of) (the )?(gnu )?"


def _gnu(name: str, version: str) -> list[tuple[str, str, str]]:
    number = version.replace(".", "[.]")
    which = _GNU[name] + rf".* version {number}( |$|[^0-9.])"
    short = _UNDER + name.lower() + rf"[ -]?(v|version )?[.]? ?{number}" + ("([.]0)?" if "." not in version else "")
    return [
        (f"{name}{version}+", "license", which + f".*{_LATER}"),
        (f"{name}{version}+", "gpl", short + "([+]|-or-later)"),
        (f"{name}{version}+", "gpl", short + f" .*{_LATER}"),
        (f"{name}{version}", "license", which),
        (f"{name}{version}", "gpl", short + "(-only| |$)"),
    ]


def _cc_version(v: str) -> str:
    return rf"[ -](v|version )?{v.replace('.', '[.]')}( |$)"


#: Known sentences: identifier, a word that every such sentence contains, pattern over the normalised sentence. The
#: first pattern that fits names the sentence, so narrower ones come first.
SENTENCES = [
    *[x for name, version in (("LGPL", "2.1"), ("LGPL", "2"), ("LGPL", "3"), ("AGPL", "3"), ("GPL", "3"), ("GPL", "2")) for x in _gnu(name, version)],
    ("GPLseen", "license", r"(received|see) .*gnu (lesser |affero |library )?general public license"),
    ("Apache2", "license", r"licensed under the apache license version 2\.0"),
    ("Apache2title", "license", r"^apache license version 2\.0( january 2004|$)"),
    ("Apache2ref", "license", r"(under|license) (the )?apache([ -]license)?( version|[ -]v)?[ -]?2([.]0)?( |$)"),
    ("Apache2use", "license", r"you may not use this file except in compliance with the license"),
    ("Apache2copy", "license", r"you may obtain a copy of the license at"),
    ("Apache2dist", "license", r"unless required by applicable law or agreed to in writing software distributed under the license"),
    ("Apache2lang", "license", r"see the license for the specific language"),
    ("MITgrant", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("MITnotice", "permission", r"the above copyright notice and this permission notice .*shall be included"),
    ("MITasis", "software", r"^the software is provided as is without warranty of any kind"),
    ("MITref", "license", r"(released|licensed|distributed|available) under (the terms of )?the mit license"),
    ("MITref", "license", r"(^| )license (is )?(the )?mit( |$)|^(the )?mit license( mit)?$"),
    ("Zlibgrant", "permission", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("Zlibasis", "software", r"^this software is provided as-is without any express or implied warranty"),
    ("Zlibref", "license", r"(released|licensed|distributed|available) under (the terms of )?the zlib license"),
    ("ISCgrant", "permission", r"permission to use copy modify and(-|/| )or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISCasis", "software", r"the software is provided as is and the author disclaims all warranties"),
    ("ISCref", "license", r"(released|licensed|distributed|available) under (the terms of )?the isc license"),
    ("Unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("BSLgrant", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("BSLref", "license", r"(distributed|licensed|released) under the boost software license version 1\.0"),
    ("EPL2", "license", r"eclipse public license.* (v\. ?|v ?|version )2\.0"),
    ("EPL1", "license", r"eclipse public license.* (v\. ?|v ?|version )1\.0"),
    ("BSDgrant", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSDsource", "redistribution", r"redistributions of source code must retain the above copyright"),
    ("BSDbinary", "redistribution", r"redistributions in binary form must reproduce the above copyright"),
    ("BSDname", "endorse", r"neither the name of .*endorse or promote"),
    ("BSDasis", "software", r"this software is provided by the .*as is"),
    ("BSD3ref", "license", r"(under|license) (the )?((new |modified )bsd|bsd[ -]3-clause|3-clause bsd)( |$)"),
    ("BSD2ref", "license", r"(under|license) (the )?((simplified |freebsd )bsd|bsd[ -]2-clause|2-clause bsd)( |$)"),
    ("BSDref", "license", r"(released|licensed|distributed|available) under the (new |simplified |3-clause |2-clause )?bsd license"),
    *[(f"CC-{kind}-{v}", "commons", f"creative commons {title}( license)?" + _cc_version(v)) for kind, title in CC_KINDS for v in CC_VERSIONS],
    *[(f"CC-{kind}-{v}", "license", f"licensed under .*cc[ -]{kind.lower()}" + _cc_version(v)) for kind, _ in CC_KINDS for v in CC_VERSIONS],
    ("CC0", "cc0", r"cc0 1\.0"),
    ("MPL2", "license", r"mozilla public license.* (v\. ?|v ?|version )2\.0"),
    ("Rights", "reserved", r"all rights reserved"),
]

#: Rules in order: license, sequence of sentences. A rule that fits takes its sentences, so longer texts come first.
LICENSE_RULES = [
    ("BSD-3-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDname", "BSDasis"]),
    ("BSD-2-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDasis"]),
    ("MIT", ["MITgrant", "MITnotice", "MITasis"]),
    ("ISC", ["ISCgrant", "ISCasis"]),
    ("Apache-2.0", ["Apache2", "Apache2use", "Apache2copy", "Apache2dist", "Apache2lang"]),
    ("Apache-2.0", ["Apache2", "Apache2copy"]),
    ("Apache-2.0", ["Apache2"]),
    ("Apache-2.0", ["Apache2title"]),
    ("Apache-2.0", ["Apache2ref"]),
    ("GPL-3.0-or-later", ["GPL3+"]),
    ("GPL-2.0-or-later", ["GPL2+"]),
    ("GPL-3.0-only", ["GPL3"]),
    ("GPL-2.0-only", ["GPL2"]),
    ("LGPL-2.1-or-later", ["LGPL2.1+"]),
    ("LGPL-2.0-or-later", ["LGPL2+"]),
    ("LGPL-3.0-or-later", ["LGPL3+"]),
    ("LGPL-2.1-only", ["LGPL2.1"]),
    ("LGPL-2.0-only", ["LGPL2"]),
    ("LGPL-3.0-only", ["LGPL3"]),
    ("AGPL-3.0-or-later", ["AGPL3+"]),
    ("AGPL-3.0-only", ["AGPL3"]),
    ("MIT", ["MITref"]),
    ("ISC", ["ISCref"]),
    ("Zlib", ["Zlibasis", "Zlibgrant"]),
    ("Zlib", ["Zlibgrant"]),
    ("Zlib", ["Zlibref"]),
    ("Unlicense", ["Unlicense"]),
    ("BSL-1.0", ["BSLgrant"]),
    ("BSL-1.0", ["BSLref"]),
    ("EPL-2.0", ["EPL2"]),
    ("EPL-1.0", ["EPL1"]),
    ("BSD-3-Clause", ["BSD3ref"]),
    ("BSD-2-Clause", ["BSD2ref"]),
    ("BSD", ["BSDref"]),
    *[(f"CC-{kind}-{v}", [f"CC-{kind}-{v}"]) for kind, _ in CC_KINDS for v in CC_VERSIONS],
    ("CC0-1.0", ["CC0"]),
    ("MPL-2.0", ["MPL2"]),
]

#: A sentence ends at . ! ? before white space, and at a blank line; other line ends are white space inside it.
SENTENCE_END = r"[.!?][ \t\r\n]+|\n[ \t\r]*\n"
#: The point of "v. 2.0" ends no sentence.
VERSION, JOINED = r"([ (][vV])[.][ \t\r\n]+([0-9])", "$1.$2"
#: Normalised sentences are lower-case words, numbers and . + - between single spaces.
NOISE = r"[^a-z0-9.+-]+"
DOTS, LAST_DOT = r"[.][.]+", r"[.]( |$)"
#: What a sentence denies is taken out before it is recognised: "not licensed under A but under B" says B, "may not be
#: distributed except under A" says A, otherwise all from the denial on is dropped. Repeats are bounded.
_NOT = r"(^| )(not|never|no longer|isn t|aren t|wasn t|rather than|instead of|neither) ((be|been|yet|now|currently|itself|being|made) ){0,3}"
_VERB = r"(licensed|released|distributed|available|covered|governed|provided|published|offered|redistributed|relicensed|license|release|distribute|redistribute|relicense)"
DENIALS = [
    (_NOT + _VERB + r" ([^ ]+ ){0,3}(except|unless|other than) under ", " licensed under "),
    (_NOT + f"({_VERB} ([^ ]+ ){{0,3}})?under ([^ ]+ ){{1,16}}?but (rather |instead |only )?((is |are )?{_VERB} )?under ", " licensed under "),
    (_NOT + f"({_VERB} ([^ ]+ ){{0,3}})?under .*", ""),
]


def _tag(name: str) -> str:
    return f"<{name}>"


def normalised(sentence: Column) -> Column:
    plain = F.regexp_replace(F.lower(sentence), NOISE, " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(plain, DOTS, "."), LAST_DOT, "$1"))


def affirmed(sentence: Column) -> Column:
    """A normalised sentence without what it denies."""
    for pattern, instead in DENIALS:
        sentence = F.regexp_replace(sentence, pattern, instead)
    return F.btrim(sentence)


def _fits(sentence: str, pattern: str) -> str:
    """Whether the pattern fits somewhere, as SQL. Its parts between ``.*`` are looked for one behind the other, each where
    it first occurs, so that the time is linear in the sentence."""
    first, *others = pattern.split(".*")
    fits, rest = f"{sentence} RLIKE r'{first}'", sentence
    for part in others:
        rest = f"get(split({rest}, r'{first}', 2), 1)"
        fits, first = f"{fits} AND {rest} RLIKE r'{part}'", part
    return fits


def sentence_id(sentence: str) -> str:
    """Tag of a normalised sentence, null if unknown, as SQL: one text is built far faster than thousands of columns."""
    return "CASE " + " ".join(f"WHEN {_fits(sentence, pattern)} THEN '{_tag(name)}'" for name, _, pattern in SENTENCES) + " END"


def _lookup(names: dict[str, str], key: Column) -> Column:
    pairs = ", ".join(f"'{a}', '{b}'" for a, b in names.items())
    return F.element_at(F.expr(f"map({pairs})"), key)


def spdx_ids(sentence: Column) -> Column:
    """Tags of the known licenses of each SPDX expression in a normalised sentence, with their exceptions, in order."""

    def name(term: Column) -> Column:
        license, exception = _lookup(SPDX_NAMES, F.substring_index(term, "/", 1)), _lookup(EXCEPTION_NAMES, F.substring_index(term, "/", -1))
        return F.concat(F.lit("<SPDX-"), license, F.coalesce(F.concat(F.lit(" WITH "), exception), F.lit("")), F.lit(">"))

    def terms(line: Column) -> Column:
        joined = F.regexp_replace(F.regexp_replace(line, " with ", "/"), " (or|and) ", "|")
        return F.split(F.substring_index(joined, " ", 1), "[|]")

    lines = F.split(sentence, SPDX_LINE)
    return F.array_compact(F.transform(F.flatten(F.transform(F.slice(lines, 2, F.size(lines)), terms)), name))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentences, licenses, unmatched, n_sentences) of every row.

    ``sentences``: tags of the known license sentences of the whole text, in order. ``licenses``: names of the ordered
    rules whose sequence occurs in it, comma-separated, each once, in the order of the rules; a rule takes its
    sentences, in each place where they occur. The licenses of SPDX expressions (alternatives, conjunctions, with their
    exceptions) follow in the order of the text. A license that a sentence denies is not named. ``unmatched``: tags no rule took. ``n_sentences`` long: known sentences.

    One projection: no shuffle, no Python. Texts and sentences without any of the words that known sentences contain are
    passed over first, which changes nothing in the result. Null and empty texts have no sentences (empty strings, 0).
    Null or repeated ids and repeated rows are each returned; other columns are ignored.
    """
    words = sorted({word for _, word, _ in SENTENCES} | {"spdx"})
    may_be_known = lambda text: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    given = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.lower(F.col(text_col)).alias("low"))
    sentences = F.filter(F.split(F.regexp_replace("text", VERSION, JOINED), SENTENCE_END, -1), lambda s: may_be_known(F.lower(s)))
    # each step is a transform of its own, so that its result is computed once and not in every branch of the next
    clean = F.transform(sentences, normalised)
    given = given.withColumn("clean", F.transform(clean, lambda s: F.struct(s.alias("whole"), affirmed(s).alias("affirmed"))))
    known = F.expr(f"transform(clean, s -> {sentence_id('s.affirmed')})")
    spdx = F.transform("clean", lambda s: F.when(s["whole"].contains(SPDX_LINE), spdx_ids(s["whole"])))
    # of each sentence the tags of its SPDX expressions, then that of a known sentence
    found = F.array_compact(F.flatten(F.zip_with(spdx, known, lambda a, b: F.array_append(F.coalesce(a, F.array().cast("array<string>")), b))))
    tagged = given.select(id_col, F.when(may_be_known(F.col("low")), found).alias("tags"))
    rules = F.expr("array(" + ", ".join(f"struct('{n}' AS name, '{''.join(map(_tag, run))}' AS run)" for n, run in LICENSE_RULES) + ")")
    start = F.struct(F.array_join("tags", "").alias("rest"), F.array().cast("array<string>").alias("names"))

    def apply(state, rule):
        fits = F.contains(state["rest"], rule["run"])
        names = F.when(fits, F.array_union(state["names"], F.array(rule["name"]))).otherwise(state["names"])
        return F.struct(F.replace(state["rest"], rule["run"], F.lit(".")).alias("rest"), names.alias("names"))

    matched = tagged.select(id_col, "tags", F.when(F.size("tags") > 0, F.aggregate(rules, start, apply)).alias("state"))
    lines = F.transform(F.filter("tags", lambda x: x.startswith("<SPDX-")), lambda x: F.substring(x, 7, F.length(x) - 7))
    return matched.select(
        id_col,
        F.coalesce(F.array_join("tags", ""), F.lit("")).alias("sentences"),
        F.coalesce(F.array_join(F.array_union("state.names", lines), ","), F.lit("")).alias("licenses"),
        F.coalesce(F.replace(F.regexp_replace("state.rest", "<SPDX-[^>]*>", ""), F.lit("."), F.lit("")), F.lit("")).alias("unmatched"),
        F.coalesce(F.greatest(F.size("tags"), F.lit(0)), F.lit(0)).cast("long").alias("n_sentences"),
    )


def op4_license_scan(spark, sf_dir):
    return scan_licenses(read(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    affirmed = "s"
    for pattern, instead in DENIALS:
        affirmed = f"regexp_replace({affirmed}, {quote(pattern)}, {quote(instead)}, 'g')"
    table = lambda names: "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in names.items()) + "}"
    case = " ".join(f"WHEN regexp_matches(s, {quote(p)}) THEN {quote(_tag(n))}" for n, _, p in SENTENCES)
    rest, names = "seq", []
    steps = []
    for i, (name, sequence) in enumerate(LICENSE_RULES):
        run = quote("".join(map(_tag, sequence)))
        steps.append(f"s{i + 1} AS (SELECT * EXCLUDE (rest), replace(rest, {run}, '.') AS rest, contains(rest, {run}) AS r{i} FROM s{i})")
        names.append(f"CASE WHEN r{i} THEN {quote(name)} END")
    plain = lambda p: quote(p.replace("\\t", "\t").replace("\\r", "\r").replace("\\n", "\n"))
    return f"""
WITH rows AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents),
parts AS (SELECT row_id, unnest(p) AS s, unnest(range(len(p))) AS ord FROM (SELECT row_id, string_split_regex(regexp_replace(text, {plain(VERSION)}, {quote(JOINED.replace('$', chr(92)))}, 'g'), {plain(SENTENCE_END)}) AS p FROM rows)),
clean AS (SELECT row_id, ord, trim(regexp_replace(regexp_replace(regexp_replace(lower(s), {quote(NOISE)}, ' ', 'g'), {quote(DOTS)}, '.', 'g'), {quote(LAST_DOT)}, '\\1', 'g'), ' ') AS s FROM parts),
known AS (SELECT row_id, ord, CASE {case} END AS tag FROM (SELECT row_id, ord, trim({affirmed}, ' ') AS s FROM clean)),
lines AS (SELECT row_id, ord, unnest(l[2:]) AS line, unnest(range(len(l) - 1)) AS nth FROM (SELECT row_id, ord, string_split(s, {quote(SPDX_LINE)}) AS l FROM clean WHERE contains(s, {quote(SPDX_LINE)}))),
terms AS (SELECT row_id, ord, nth, unnest(t) AS term, unnest(range(len(t))) AS place FROM (SELECT *, string_split(split_part(regexp_replace(regexp_replace(line, ' with ', '/', 'g'), ' (or|and) ', '|', 'g'), ' ', 1), '|') AS t FROM lines)),
spdx AS (SELECT row_id, ord, nth, place, {table(SPDX_NAMES)}[split_part(term, '/', 1)] || coalesce(' WITH ' || {table(EXCEPTION_NAMES)}[split_part(term, '/', -1)], '') AS name FROM terms),
tags AS (SELECT row_id, ord, 0 AS kind, nth, place, '<SPDX-' || name || '>' AS tag FROM spdx UNION ALL SELECT row_id, ord, 1, 0, 0, tag FROM known),
named AS (SELECT row_id, list(name ORDER BY first) AS names FROM (SELECT row_id, name, min((ord, nth, place)) AS first FROM spdx WHERE name IS NOT NULL GROUP BY row_id, name) GROUP BY row_id),
s0 AS (SELECT r.row_id, any_value(doc_id) AS doc_id, coalesce(string_agg(tag, '' ORDER BY ord, kind, nth, place), '') AS seq,
       coalesce(string_agg(tag, '' ORDER BY ord, kind, nth, place), '') AS rest, count(tag) AS n FROM rows r LEFT JOIN tags t ON r.row_id = t.row_id GROUP BY r.row_id),
{", ".join(steps)}
SELECT doc_id, seq AS sentences, array_to_string(list_filter(names, lambda x, i: x IS NOT NULL AND NOT coalesce(list_contains(names[1:i - 1], x), false)), ',') AS licenses,
       replace(regexp_replace(rest, '<SPDX-[^>]*>', '', 'g'), '.', '') AS unmatched, n AS n_sentences
FROM (SELECT f.*, list_concat([{", ".join(names)}], coalesce(m.names, [])) AS names FROM s{len(LICENSE_RULES)} f LEFT JOIN named m USING (row_id))
"""


OP4_SQL = _sql()
