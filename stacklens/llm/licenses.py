"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences (at line breaks and after ``.``, ``!``, ``?`` before white space), each is
normalised, known licence sentences give identifiers, and ordered rules match runs of identifiers. Where
notices wrap over lines, the text with line breaks as spaces is cut too, and so is the text in paragraphs: known
lines, headings, copyright lines and blank lines stand alone there, and the lines between them are joined. The
view that knows more sentences counts, the first on ties. A rule that matches uses its identifiers up.

All of it happens inside a row, so a scan needs no shuffle, and only texts with a licence word are cut.
Defined results: null and empty texts have no licence (family ``none``); rows with a null or repeated id
stay, one result each; empty tables give empty results; further columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklens.llm.common import texts

# Sentences of public licence notices, normalised, with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "apache2",
    "licensed under the apache license version 2.0 the license": "apache2",
    "you may not use this file except in compliance with the license": "apache2use",
    "you may obtain a copy of the license at": "copyat",
    "you may obtain a copy of the license at http www.apache.org licenses license-2.0": "copyat",
    "unless required by applicable law or agreed to in writing software distributed under the license is "
    "distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2see",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "this project is licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation "
    "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
    "permit persons to whom the software is furnished to do so subject to the following conditions": "mitgrant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation "
    "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
    "permit persons to whom the software is furnished to do so subject to the following conditions the above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "software": "mitwhole",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the software": "mitnotice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met": "bsdgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the "
    "following disclaimer": "bsdsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution": "bsdbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission": "bsdname",
    "licensed under the bsd 2-clause license": "bsd2",
    "licensed under the bsd 3-clause license": "bsd3",
    "this work is licensed under the gnu general public license version 3": "gpl3",
    "licensed under the gnu general public license version 3": "gpl3",
    "this work is licensed under the gnu general public license version 2": "gpl2",
    "licensed under the gnu general public license version 2": "gpl2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation either version 3 of the license or at your option "
    "any later version": "gpl3later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation either version 2 of the license or at your option "
    "any later version": "gpl2later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the "
    "implied warranty of merchantability or fitness for a particular purpose": "gplwarranty",
    "see the gnu general public license for more details": "gplsee",
    "licensed under the gnu lesser general public license version 3": "lgpl3",
    "licensed under the gnu affero general public license version 3": "agpl3",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2",
    "licensed under the mozilla public license version 2.0": "mpl2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by 4.0": "ccby4",
    "licensed under cc by-sa 4.0": "ccbysa4",
    "licensed under cc by-nc 4.0": "ccbync4",
    "licensed under cc by-nc-sa 4.0": "ccbyncsa4",
    "licensed under cc by-nd 4.0": "ccbynd4",
    "this work is licensed under a creative commons attribution 4.0 international license": "ccby4",
    "this work is licensed under a creative commons attribution-sharealike 4.0 international license": "ccbysa4",
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license": "ccbync4",
    "all rights reserved": "reserved",
}
# Ordered rules (identifiers in order, licence, family); longer notices come first.
RULES = [
    (("apache2", "apache2use", "copyat", "apache2asis", "apache2see"), "Apache-2.0", "permissive"),
    (("apache2",), "Apache-2.0", "permissive"),
    (("mitgrant", "mitnotice"), "MIT", "permissive"), (("mitwhole",), "MIT", "permissive"),
    (("mitgrant",), "MIT", "permissive"), (("mit",), "MIT", "permissive"), (("isc",), "ISC", "permissive"),
    (("bsdgrant", "bsdsource", "bsdbinary", "bsdname"), "BSD-3-Clause", "permissive"),
    (("bsdgrant", "bsdsource", "bsdbinary"), "BSD-2-Clause", "permissive"),
    (("bsd3",), "BSD-3-Clause", "permissive"), (("bsd2",), "BSD-2-Clause", "permissive"),
    (("gpl3later", "gplwarranty", "gplsee"), "GPL-3.0-or-later", "copyleft"),
    (("gpl2later", "gplwarranty", "gplsee"), "GPL-2.0-or-later", "copyleft"),
    (("gpl3later",), "GPL-3.0-or-later", "copyleft"), (("gpl2later",), "GPL-2.0-or-later", "copyleft"),
    (("agpl3",), "AGPL-3.0", "copyleft"), (("lgpl3",), "LGPL-3.0", "copyleft"),
    (("gpl3",), "GPL-3.0", "copyleft"), (("gpl2",), "GPL-2.0", "copyleft"), (("mpl2",), "MPL-2.0", "copyleft"),
    (("ccbyncsa4",), "CC-BY-NC-SA-4.0", "restricted"), (("ccbync4",), "CC-BY-NC-4.0", "restricted"),
    (("ccbynd4",), "CC-BY-ND-4.0", "restricted"), (("ccbysa4",), "CC-BY-SA-4.0", "copyleft"),
    (("ccby4",), "CC-BY-4.0", "permissive"), (("unlicense",), "Unlicense", "permissive"),
    (("reserved",), "All-rights-reserved", "restricted"),
]
#: A text without any of these words can hold no known sentence.
WORDS = "(?i)licen[cs]e|permi(ssion|tted)|redistribut|free[^a-z0-9]+software|public[^a-z0-9]+domain|rights[^a-z0-9]+reserved|warranty|copyright"
FAMILIES = ("restricted", "copyleft", "permissive")
ENDS = r"([.!?])[ \t\r\n]+"


#: Normalised lines that stand alone: blank ones, copyright lines, and titles of licences.
ALONE = r"^$|^copyright( .*)?$|^([a-z0-9.-]+ ){0,4}licen[cs]e( version)?( [0-9.]+)?$"


def _norm(s: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9.-]+", " ")), r"[. ]+$", "")


def _paragraphs(text: Column) -> Column:
    """The text with its line breaks as spaces, but for those around lines that stand alone."""
    def line(s: Column) -> Column:
        alone = _norm(s).rlike(ALONE) | _norm(s).isin(*SENTENCES)
        return F.when(alone, F.concat(F.lit("\n"), s, F.lit("\n"))).otherwise(F.concat(s, F.lit(" ")))

    return F.array_join(F.transform(F.split(text, "\n"), line), "")


def _ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    cut = F.split(F.regexp_replace(text, ENDS, "$1\n"), "\n")
    norm = F.transform(cut, _norm)
    by_id: dict[str, list[str]] = {}
    for sentence, name in SENTENCES.items():
        by_id.setdefault(name, []).append(sentence)
    lookup = lambda s: reduce(lambda w, kv: w.when(s.isin(*kv[1]), kv[0]), by_id.items(), F.when(F.lit(False), ""))
    return F.filter(F.transform(F.filter(norm, lambda s: s.isin(*SENTENCES)), lookup), lambda x: x.isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``sentences`` (identifiers in order), ``licences`` (in order of the rules), ``family``
    (the strictest among them; ``unknown``: known sentences but no rule; ``none``)."""
    d = texts(docs, id_col, text_col)
    empty = F.array().cast("array<string>")
    seen = F.col("text").rlike(WORDS)
    d = d.select("doc_id", F.when(seen, _ids(F.col("text"))).otherwise(empty).alias("a"),
                 F.when(seen, _ids(F.replace("text", F.lit("\n"), F.lit(" ")))).otherwise(empty).alias("b"),
                 F.when(seen, _ids(_paragraphs(F.col("text")))).otherwise(empty).alias("c"))
    d = d.select("doc_id", "c", F.when(F.size("b") > F.size("a"), F.col("b")).otherwise(F.col("a")).alias("ab"))
    d = d.select("doc_id", F.when(F.size("c") > F.size("ab"), F.col("c")).otherwise(F.col("ab")).alias("sentences"))
    # each identifier stands between its own commas, so that neighbours share none
    rest, found = F.concat(F.lit(","), F.array_join("sentences", ",,"), F.lit(",")), []
    for k, (names, _, _) in enumerate(RULES):
        run = "".join(f",{n}," for n in names)
        d = d.withColumn("rest" if not k else "rest2", rest).withColumn(f"r{k}", F.contains("rest" if not k else "rest2", F.lit(run)))
        rest = F.replace("rest" if not k else "rest2", F.lit(run), F.lit(",#,"))
        found.append(k)
    hits = F.filter(F.array(*(F.when(F.col(f"r{k}"), F.lit(RULES[k][1])) for k in found)), lambda x: x.isNotNull())
    family = F.lit("none")
    family = F.when(F.size("sentences") > 0, F.lit("unknown")).otherwise(family)
    for name in reversed(FAMILIES):
        family = F.when(reduce(lambda a, b: a | b, (F.col(f"r{k}") for k in found if RULES[k][2] == name)), name).otherwise(family)
    return d.select("doc_id", "sentences", F.array_distinct(hits).alias("licences"), family.alias("family"))


def op10_license_scan(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", F.array_join("sentences", ",").alias("sentences"),
                             F.array_join("licences", ";").alias("licences"), "family")


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quote(s)}, {quote(n)})" for s, n in SENTENCES.items())
    norm = "regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9.-]+', ' ', 'g')), '[. ]+$', '')"
    view = lambda text: (f"list_filter(list_transform(list_transform(string_split(regexp_replace({text}, '{ENDS}', '\\1' || chr(10), 'g'), chr(10)), "  # noqa: E731
                         f"lambda s: {norm}), lambda s: map_extract_value(m, s)), lambda x: x IS NOT NULL)")
    paragraphs = (f"array_to_string(list_transform(string_split(text, chr(10)), lambda s: CASE WHEN regexp_matches({norm}, '{ALONE}') "
                  f"OR map_extract_value(m, {norm}) IS NOT NULL THEN chr(10) || s || chr(10) ELSE s || ' ' END), '')")
    steps, last = [], "s0"
    for k, (names, _, _) in enumerate(RULES):
        run = quote("".join(f",{n}," for n in names))
        steps.append(f"s{k + 1} AS (SELECT * EXCLUDE rest, contains(rest, {run}) AS r{k}, replace(rest, {run}, ',#,') AS rest FROM {last})")
        last = f"s{k + 1}"
    hits = ", ".join(f"CASE WHEN r{k} THEN {quote(x[1])} END" for k, x in enumerate(RULES))
    family = " ".join(f"WHEN {' OR '.join(f'r{k}' for k, x in enumerate(RULES) if x[2] == f)} THEN '{f}'" for f in FAMILIES)
    first = "list_filter(hits, lambda x, i: x IS NOT NULL AND NOT list_contains(list_slice(hits, 1, i - 1), x))"
    return (f"WITH known AS (SELECT map_from_entries(list((s, n))) AS m FROM (VALUES {table}) t(s, n)), "
            "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), "
            f"v AS (SELECT doc_id, {view('text')} AS a, {view("replace(text, chr(10), ' ')")} AS b, {view(paragraphs)} AS c FROM d, known), "
            "c AS (SELECT doc_id, CASE WHEN len(c) > greatest(len(a), len(b)) THEN c WHEN len(b) > len(a) THEN b ELSE a END AS ids FROM v), "
            "s0 AS (SELECT doc_id, ids, ',' || array_to_string(ids, ',,') || ',' AS rest FROM c), "
            + ", ".join(steps) + f", h AS (SELECT *, [{hits}] AS hits FROM {last}) "
            f"SELECT doc_id, array_to_string(ids, ',') AS sentences, array_to_string({first}, ';') AS licences, "
            f"CASE {family} WHEN len(ids) > 0 THEN 'unknown' ELSE 'none' END AS family FROM h")


OP10_SQL = _sql()
