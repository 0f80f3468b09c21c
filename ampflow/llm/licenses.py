"""Licence scans by sentence rules, in DataFrame functions only.

A text is normalised (lower case, runs of other characters than a-z, digits,
dots and plus signs to one space) and cut into sentences; colons and semicolons
end none.  Each sentence is mapped to the identifiers of all known licence
sentences that it holds, in their order (of those at one place the longest);
other sentences have none.  The sequence of identifiers is then matched against
the licence rules in their order; what a rule matches is taken out of the
sequence before the next.  Identifiers that no rule takes are left over.

Everything happens within a row, so nothing is shuffled.  Null and empty texts
have no sentence; their licence is ``none``.  A text with left-over identifiers
only is ``unknown``.  Repeated rows give repeated rows, an empty table none.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of common licences as normalised, by identifier; (a|b|) stands for any of a, b, nothing.
SENTENCES = [
    ("ApacheRef", "licensed under the apache license version 2.0"),
    ("ApacheRef", "apache( software|) license (version |v|)2.0"),
    ("ApacheRef", "apache (version |v|)2.0 license"),
    ("ApacheComply", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at"),
    ("ApacheAsIs", "distributed under the license is distributed on an as is basis"),
    ("ApacheLimits", "see the license for the specific language governing permissions"),
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included"),
    ("MitAsIs", "the software is provided as is without warranty of any kind"),
    ("MitLiable", "in no event shall the authors or copyright holders be liable"),
    ("MitRef", "(released|licensed|distributed|available) under the (terms of the |)mit license"),
    ("MitRef", "mit license(d|)"),
    ("IscGrant", "permission to use copy modify and( or|) distribute this software for any purpose"),
    ("IscAsIs", "the software is provided as is and the author disclaims all warranties"),
    ("IscRef", "isc license"),
    ("BsdGrant", "redistribution and use in source and binary forms"),
    ("BsdSource", "redistributions of source code must retain the above copyright"),
    ("BsdBinary", "redistributions in binary form must reproduce the above copyright"),
    ("BsdEndorse", "neither the name of it may be used to endorse or promote products"),
    ("BsdAdvertise", "all advertising materials mentioning features or use of this software"),
    ("BsdAsIs", "this software is provided by the (copyright holders|regents|author)( and contributors|) as is"),
    ("BsdLiable", "in no event shall the (copyright holder|copyright holders|copyright owner|copyright owners|regents|author)( or contributors|) be liable"),
    ("Bsd3Ref", "bsd 3 clause"),
    ("Bsd3Ref", "3 clause bsd"),
    ("Bsd2Ref", "bsd 2 clause"),
    ("Bsd2Ref", "2 clause bsd"),
    ("AgplFree", "free software you (can|may) redistribute it and( or|) modify it under the terms of the gnu affero general public license"),
    ("LgplFree", "free software you (can|may) redistribute it and( or|) modify it under the terms of the gnu (lesser|library) general public license"),
    ("GplFree2", "free software you (can|may) redistribute it and( or|) modify it under the terms of the gnu general public license( as published by the free software foundation|) version 2"),
    ("GplFree2", "free software you (can|may) redistribute it and( or|) modify it under the terms of version 2 of the gnu general public license"),
    ("GplFree3", "free software you (can|may) redistribute it and( or|) modify it under the terms of the gnu general public license( as published by the free software foundation|) version 3"),
    ("GplFree3", "free software you (can|may) redistribute it and( or|) modify it under the terms of version 3 of the gnu general public license"),
    ("GplFree", "free software you (can|may) redistribute it and( or|) modify it under the terms of the gnu general public license"),
    ("LgplSee", "see the gnu (lesser|library) general public license for more details"),
    ("AgplReceived", "you should have received a copy of the gnu affero general public license"),
    ("LgplReceived", "you should have received a copy of the gnu (lesser|library) general public license"),
    ("GplReceived", "you should have received a copy of the gnu general public license"),
    ("AgplRef", "gnu affero general public license (version|v)( |)3"),
    ("AgplRef", "agpl( |)(v|)3"),
    ("Lgpl3Ref", "gnu lesser general public license (version|v)( |)3"),
    ("Lgpl3Ref", "lgpl( |)(v|)3"),
    ("Lgpl21Ref", "gnu lesser general public license (version|v)( |)2.1"),
    ("Lgpl21Ref", "lgpl( |)(v|)2.1"),
    ("LgplRef", "gnu (lesser|library) general public license"),
    ("Gpl3Ref", "gnu general public license (version|v)( |)3"),
    ("Gpl3Ref", "gpl( |)(v|)3"),
    ("Gpl2Ref", "gnu general public license (version|v)( |)2"),
    ("Gpl2Ref", "gpl( |)(v|)2"),
    ("Later21", "either version 2.1 of the license"),
    ("GplLater3", "either version 3 of the license"),
    ("GplLater2", "either version 2 of the license"),
    ("GplHope", "distributed in the hope that it will be useful"),
    ("Mpl2Ref", "mozilla public license (version |v |v|)2.0"),
    ("EplRef", "eclipse public license"),
    ("CcByNcSa", "cc by nc sa"),
    ("CcByNcSa", "creative commons attribution noncommercial sharealike"),
    ("CcByNcNd", "cc by nc nd"),
    ("CcByNcNd", "creative commons attribution noncommercial noderivatives"),
    ("CcByNc", "cc by nc"),
    ("CcByNc", "creative commons attribution noncommercial"),
    ("CcBySa", "cc by sa"),
    ("CcBySa", "creative commons attribution sharealike"),
    ("CcByNd", "cc by nd"),
    ("CcByNd", "creative commons attribution noderivatives"),
    ("Cc0", "cc0"),
    ("Cc0", "creative commons zero"),
    ("CcBy", "cc by"),
    ("CcBy", "creative commons attribution"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("PublicDomain", "(released|placed|dedicated) (in|into|to) the public domain"),
    ("ZlibGrant", "permission is granted to anyone to use this software for any purpose"),
    ("ZlibRef", "zlib license"),
    ("BoostRef", "boost software license"),
    ("AllRights", "all rights reserved"),
    ("SpdxMit", "spdx license identifier mit"),
    ("SpdxApache", "spdx license identifier apache 2.0"),
    ("SpdxAgpl3", "spdx license identifier agpl 3.0"),
    ("SpdxLgpl3", "spdx license identifier lgpl 3.0"),
    ("SpdxLgpl21", "spdx license identifier lgpl 2.1"),
    ("SpdxGpl3Later", "spdx license identifier gpl 3.0(+| or later)"),
    ("SpdxGpl3", "spdx license identifier gpl 3.0"),
    ("SpdxGpl2Later", "spdx license identifier gpl 2.0(+| or later)"),
    ("SpdxGpl2", "spdx license identifier gpl 2.0"),
    ("SpdxBsd4", "spdx license identifier bsd 4 clause"),
    ("SpdxBsd3", "spdx license identifier bsd 3 clause"),
    ("SpdxBsd2", "spdx license identifier bsd 2 clause"),
    ("SpdxIsc", "spdx license identifier isc"),
    ("SpdxMpl2", "spdx license identifier mpl 2.0"),
    ("SpdxEpl", "spdx license identifier epl (1|2).0"),
    ("SpdxZlib", "spdx license identifier zlib"),
    ("SpdxBoost", "spdx license identifier bsl 1.0"),
    ("SpdxUnlicense", "spdx license identifier unlicense"),
    ("CcByNcSa", "spdx license identifier cc by nc sa"),
    ("CcByNcNd", "spdx license identifier cc by nc nd"),
    ("CcByNc", "spdx license identifier cc by nc"),
    ("CcBySa", "spdx license identifier cc by sa"),
    ("CcByNd", "spdx license identifier cc by nd"),
    ("CcBy", "spdx license identifier cc by"),
    ("Cc0", "spdx license identifier cc0"),
    ("SpdxOther", "spdx license identifier"),
    ("OtherRef", "(licensed|released|distributed) under"),
]
# Licence rules in order, each a licence and the identifiers that follow one another.
RULES = [
    ("BSD-4-Clause", "BsdGrant BsdSource BsdBinary BsdAdvertise BsdEndorse BsdAsIs BsdLiable"),
    ("BSD-3-Clause", "BsdGrant BsdSource BsdBinary BsdEndorse BsdAsIs BsdLiable"),
    ("BSD-2-Clause", "BsdGrant BsdSource BsdBinary BsdAsIs BsdLiable"),
    ("MIT", "MitRef MitGrant MitNotice MitAsIs MitLiable"),
    ("MIT", "MitGrant MitNotice MitAsIs MitLiable"),
    ("MIT", "MitGrant MitNotice MitAsIs"),
    ("ISC", "IscRef IscGrant IscAsIs"),
    ("ISC", "IscGrant IscAsIs"),
    ("Apache-2.0", "ApacheRef ApacheComply ApacheCopy ApacheAsIs ApacheLimits"),
    ("Apache-2.0", "ApacheRef ApacheComply ApacheCopy"),
    ("AGPL-3.0-or-later", "AgplFree GplLater3 GplHope AgplReceived"),
    ("AGPL-3.0-or-later", "AgplFree GplLater3"),
    ("LGPL-3.0-or-later", "LgplFree GplLater3 GplHope LgplSee LgplReceived"),
    ("LGPL-3.0-or-later", "LgplFree GplLater3"),
    ("LGPL-2.1-or-later", "LgplFree Later21 GplHope LgplSee LgplReceived"),
    ("LGPL-2.1-or-later", "LgplFree Later21"),
    ("LGPL-2.0-or-later", "LgplFree GplLater2 GplHope LgplSee LgplReceived"),
    ("LGPL-2.0-or-later", "LgplFree GplLater2"),
    ("GPL-3.0-or-later", "GplFree GplLater3 GplHope GplReceived"),
    ("GPL-3.0-or-later", "GplFree GplLater3"),
    ("GPL-2.0-or-later", "GplFree GplLater2 GplHope GplReceived"),
    ("GPL-2.0-or-later", "GplFree GplLater2"),
    ("GPL-3.0", "GplFree3 GplHope GplReceived"),
    ("GPL-3.0", "GplFree3"),
    ("GPL-2.0", "GplFree2 GplHope GplReceived"),
    ("GPL-2.0", "GplFree2"),
    ("Apache-2.0", "SpdxApache"),
    ("Apache-2.0", "ApacheRef"),
    ("MIT", "SpdxMit"),
    ("MIT", "MitRef"),
    ("ISC", "SpdxIsc"),
    ("ISC", "IscRef"),
    ("ISC", "IscGrant"),
    ("Zlib", "SpdxZlib"),
    ("Zlib", "ZlibRef"),
    ("Zlib", "ZlibGrant"),
    ("AGPL-3.0", "SpdxAgpl3"),
    ("AGPL-3.0", "AgplRef"),
    ("LGPL-3.0", "SpdxLgpl3"),
    ("LGPL-3.0", "Lgpl3Ref"),
    ("LGPL-2.1", "SpdxLgpl21"),
    ("LGPL-2.1", "Lgpl21Ref"),
    ("LGPL", "LgplRef"),
    ("LGPL", "LgplFree"),
    ("GPL-3.0-or-later", "SpdxGpl3Later"),
    ("GPL-3.0", "SpdxGpl3"),
    ("GPL-3.0", "Gpl3Ref"),
    ("GPL-2.0-or-later", "SpdxGpl2Later"),
    ("GPL-2.0", "SpdxGpl2"),
    ("GPL-2.0", "Gpl2Ref"),
    ("BSD-4-Clause", "SpdxBsd4"),
    ("BSD-3-Clause", "SpdxBsd3"),
    ("BSD-3-Clause", "Bsd3Ref"),
    ("BSD-2-Clause", "SpdxBsd2"),
    ("BSD-2-Clause", "Bsd2Ref"),
    ("MPL-2.0", "SpdxMpl2"),
    ("MPL-2.0", "Mpl2Ref"),
    ("EPL", "SpdxEpl"),
    ("EPL", "EplRef"),
    ("CC-BY-NC-SA", "CcByNcSa"),
    ("CC-BY-NC-ND", "CcByNcNd"),
    ("CC-BY-NC", "CcByNc"),
    ("CC-BY-SA", "CcBySa"),
    ("CC-BY-ND", "CcByNd"),
    ("CC0", "Cc0"),
    ("CC-BY", "CcBy"),
    ("Unlicense", "SpdxUnlicense"),
    ("Unlicense", "Unlicense"),
    ("Public-domain", "PublicDomain"),
    ("BSL-1.0", "SpdxBoost"),
    ("BSL-1.0", "BoostRef"),
    ("Proprietary", "AllRights"),
]
#: A licence only where there is no other.
LAST = "Proprietary"


def phrases(template: str) -> list[str]:
    """All sentences that a template stands for."""
    parts = [p[1:-1].split("|") if p[:1] == "(" else [p] for p in re.split(r"(\([^()]*\))", template)]
    return ["".join(p) for p in product(*parts)]


def _known() -> dict[str, str]:
    """Normalised sentence to identifier; the first of equal ones counts."""
    out: dict[str, str] = {}
    for name, template in SENTENCES:
        for phrase in phrases(template):
            out.setdefault(phrase, name)
    return out


def _hints(known: list[str]) -> list[str]:
    """Words of which every known sentence has one: the word that most sentences share, then that of most of the rest, and so on."""
    every = {p: re.findall("[a-z0-9]+", p) for p in known}
    words = {p: {w for w in ws if (len(w) > 5 or "gpl" in w) and w != "public"} or {ws[0]} for p, ws in every.items()}
    out = []
    while words:
        counts = Counter(w for ws in words.values() for w in ws)
        best = max(counts, key=lambda w: (counts[w], len(w), w))
        out.append(best)
        words = {p: ws for p, ws in words.items() if best not in ws}
    return sorted(out)


KNOWN = _known()
#: Any known sentence; of those at one place the longest.
ANY = r"\b(?:" + "|".join(p.replace(".", r"\.").replace("+", r"\+") + (r"\b" if p[-1].isalnum() else "") for p in sorted(KNOWN, key=lambda p: (-len(p), p))) + ")"
#: A text in lower case without any of these words has no known sentence; nor has a sentence.
HINTS = rf"\b(?:{'|'.join(_hints(list(KNOWN)))})\b".replace("license", "licen[cs]e")
_TAG = r"(?:mit|isc|zlib|unlicense|apache 2\.0|mpl 2\.0|epl [12]\.0|bsl 1\.0|[al]?gpl [0-9.]+(?:\+| or later| only)?|bsd [0-9] clause|cc by(?: nc| sa| nd)* [0-9.]+|cc0 1\.0)"
#: (pattern, replacement, where it applies) in turn, on the text in lower case.
NORMAL = [
    (r"[ \t\n\r\f\x0b]+", " "),
    (r"\b(v|inc)\. ", "$1 "),  # no sentence ends at "v. 3"
    (r"([.!?]) ", "$1\n"),
    (r"[^a-z0-9.+\n]+", " "),
    (r"\blicence", "license"),
    (r"neither the name of [^\n]*? may be used", "neither the name of it may be used"),
]
SPDX = "spdx license identifier"
#: In an SPDX expression every member is a tag.
MEMBERS = (rf" (?:or|and|with) ({_TAG})", f" {SPDX} $1")


def normal(low: Column) -> Column:
    """A text in lower case normalised, a sentence a line."""
    out = low
    for pattern, to in NORMAL:
        out = F.regexp_replace(out, pattern, to)
    return out


def _sentence_ids(sentence: Column) -> Column:
    """All identifiers of a sentence; OtherRef only if there is no other."""
    sentence = F.when(sentence.contains(SPDX), F.regexp_replace(sentence, *MEMBERS)).otherwise(sentence)
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    every = F.transform(F.regexp_extract_all(sentence, F.lit(f"({ANY})"), F.lit(1)), lambda p: F.element_at(known, p))
    named = F.filter(every, lambda x: x != "OtherRef")
    return F.when(F.size(named) > 0, named).otherwise(F.slice(every, 1, 1))


def sentence_ids(low: Column) -> Column:
    """The identifiers of the licence sentences of a text in lower case, in order; empty where there are none."""
    hinted = F.filter(F.split(normal(low), "\n"), lambda s: s.rlike(HINTS))
    named = F.flatten(F.transform(hinted, _sentence_ids))
    return F.when(low.rlike(HINTS.replace(r"\b", "(?<![a-z0-9])", 1).removesuffix(r"\b") + "(?![a-z0-9])"), named).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_sentences, sentence_ids, licenses, left_over, license.

    ``sentence_ids`` and ``licenses`` are joined by spaces in the order of the text and of the rules.
    """
    texts = docs.select("doc_id", F.lower("text").alias("low"))
    ids = texts.select("doc_id", F.coalesce(sentence_ids(F.col("low")), F.array().cast("array<string>")).alias("ids"))
    rules = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(f" {seq.replace(' ', '  ')} ").alias("seq"), F.lit(name == LAST).alias("last")) for name, seq in RULES])
    start = F.struct(F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")).alias("rest"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, r: F.when(
        F.contains(acc["rest"], r["seq"]),
        F.struct(F.replace(acc["rest"], r["seq"], F.lit("")).alias("rest"), F.when(~r["last"] | (F.size(acc["found"]) == 0), F.array_append(acc["found"], r["license"])).otherwise(acc["found"]).alias("found")),
    ).otherwise(acc)
    out = ids.withColumn("m", F.when(F.size("ids") > 0, F.aggregate(rules, start, step)))
    out = out.select("doc_id", "ids", F.coalesce(F.array_distinct("m.found"), F.array().cast("array<string>")).alias("found"), F.coalesce(F.trim(F.col("m.rest")), F.lit("")).alias("rest"))
    verdict = F.when(F.size("found") > 0, F.element_at("found", 1)).when(F.size("ids") > 0, "unknown").otherwise("none")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", " ").alias("sentence_ids"),
        F.array_join("found", " ").alias("licenses"),
        F.regexp_replace("rest", " +", " ").alias("left_over"),
        verdict.alias("license"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    """The same in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    back = lambda s: q(s.replace("$1", "\\1")).replace("\n", "' || chr(10) || '")
    text = "lower(text)"
    for pattern, to in NORMAL:
        text = f"regexp_replace({text}, {q(pattern)}, {back(to)}, 'g')"
    keys, names = "[" + ", ".join(map(q, KNOWN)) + "]", "[" + ", ".join(map(q, KNOWN.values())) + "]"
    spread = f"CASE WHEN contains(s, {q(SPDX)}) THEN regexp_replace(s, {q(MEMBERS[0])}, {back(MEMBERS[1])}, 'g') ELSE s END"
    sql = f"""WITH cut AS (SELECT doc_id, coalesce(list_filter(string_split({text}, chr(10)), lambda s: regexp_matches(s, {q(HINTS)})), []) AS sentences FROM documents),
every AS (SELECT doc_id, list_transform(sentences, lambda s: list_transform(regexp_extract_all({spread}, {q(ANY)}), lambda p: {names}[list_position({keys}, p)])) AS lists FROM cut),
named AS (SELECT doc_id, coalesce(flatten(list_transform(lists, lambda x: CASE WHEN len(list_filter(x, lambda y: y <> 'OtherRef')) > 0 THEN list_filter(x, lambda y: y <> 'OtherRef') ELSE x[1:1] END)), []) AS ids FROM every),
r0 AS (SELECT doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS rest, CAST([] AS VARCHAR[]) AS found FROM named)"""
    for i, (name, seq) in enumerate(RULES):
        s = q(f" {seq.replace(' ', '  ')} ")
        more = "AND len(found) = 0" if name == LAST else f"AND NOT list_contains(found, {q(name)})"
        sql += f",\nr{i + 1} AS (SELECT doc_id, ids, replace(rest, {s}, '') AS rest, CASE WHEN contains(rest, {s}) {more} THEN list_append(found, {q(name)}) ELSE found END AS found FROM r{i})"
    return sql + f"""
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, coalesce(array_to_string(found, ' '), '') AS licenses,
  regexp_replace(trim(rest), ' +', ' ', 'g') AS left_over,
  CASE WHEN len(found) > 0 THEN found[1] WHEN len(ids) > 0 THEN 'unknown' ELSE 'none' END AS license
FROM r{len(RULES)}"""


SQL = _sql()
