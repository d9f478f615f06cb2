"""Operator 8: license scans by sentence rules.

A text is cut into sentences at blank lines and sentence ends, after comment
marks at line starts are stripped; other line ends are white space, so wrapped
notices are read whole.  A line that is a known sentence by itself stands alone.
Each sentence is normalised to lower-case letters, digits and dots and gets the
identifier of the longest known sentence of licence notices that it contains,
which gives the text a sequence of sentence identifiers.  An ordered list of rules is
then matched against that sequence: a rule names identifiers that must follow
one another, in that order, with no other *known* sentence between them, and a
licence.  A tag that names a licence is a sentence of its own; of an expression the
first name counts.  Earlier rules take their sentences before later ones see them, so a
long notice is not also reported as the short one that it contains.

Everything is DataFrame expressions; the tables of sentences and rules are
fixed and small, so they are literals of the plan.

Defined edge cases: a null text counts as empty; a text without known sentences
has an empty list and 'none'; repeated sentences are found each time but a
licence is listed once; whole texts are read; repeated rows give repeated
results; an empty table gives an empty result; only ``doc_id`` and ``text`` are
read, so extra columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences by identifier, normalised. Fixed values from published licence notices.
SENTENCES = {
    "apache_short": "licensed under the apache license version 2.0",
    "apache_full": "licensed under the apache license version 2.0 the license",
    "apache_may_not": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "apache_as_is": "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit_short": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl_free": "this program is free software",
    "gpl_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl_version3": "either version 3 of the license or at your option any later version",
    "gpl_version2": "either version 2 of the license or at your option any later version",
    "cc_by_nc": "licensed under cc by nc 4.0",
    "cc_by_sa": "licensed under cc by sa 4.0",
    "cc_by": "licensed under cc by 4.0",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
}

#: Ordered rules: identifiers in sequence, licence. The first that match take their sentences.
RULES = (
    (("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_name"), "BSD-3-Clause"),
    (("bsd_redistribution", "bsd_source", "bsd_binary"), "BSD-2-Clause"),
    (("gpl_free", "gpl_terms", "gpl_version3"), "GPL-3.0-or-later"),
    (("gpl_free", "gpl_terms", "gpl_version2"), "GPL-2.0-or-later"),
    (("apache_full", "apache_may_not", "apache_copy", "apache_as_is"), "Apache-2.0"),
    (("mit_grant", "mit_notice"), "MIT"),
    (("apache_full",), "Apache-2.0"),
    (("apache_short",), "Apache-2.0"),
    (("mit_short",), "MIT"),
    (("mit_licensed",), "MIT"),
    (("gpl3_work",), "GPL-3.0-only"),
    (("cc_by_nc",), "CC-BY-NC-4.0"),
    (("cc_by_sa",), "CC-BY-SA-4.0"),
    (("cc_by",), "CC-BY-4.0"),
)

#: More known sentences, by identifier.
MORE_SENTENCES = (
    ("bsd_name", "contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl_terms_2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl_terms_3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl_hope", "this program is distributed in the hope that it will be useful"),
    ("gpl_version21", "either version 2.1 of the license or at your option any later version"),
    ("lgpl_terms", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl_terms_21", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"),
    ("lgpl_terms_3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl_terms", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl_terms_3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl2", "this source code form is subject to the terms of the mozilla public license v"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("apache_title", "apache license version 2.0 january 2004"),
    ("apache_terms", "terms and conditions for use reproduction and distribution"),
    ("gpl3_title", "gnu general public license version 3 29 june 2007"),
    ("gpl2_title", "gnu general public license version 2 june 1991"),
    ("gpl_body", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("cc0_title", "creative commons cc0 1.0 universal"),
    ("cc0_title", "cc0 1.0 universal"),
    ("boost_grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib_as_is", "this software is provided as is without any express or implied warranty"),
    ("zlib_grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("epl2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"),
    ("epl2", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2.0"),
)

#: More rules, after the others. A comma may join terms and version into one sentence.
MORE_RULES = (
    (("gpl_free", "gpl_terms_3"), "GPL-3.0-or-later"),
    (("gpl_free", "gpl_terms_2"), "GPL-2.0-or-later"),
    (("lgpl_terms", "gpl_version21"), "LGPL-2.1-or-later"),
    (("lgpl_terms", "gpl_version3"), "LGPL-3.0-or-later"),
    (("lgpl_terms_21",), "LGPL-2.1-or-later"),
    (("lgpl_terms_3",), "LGPL-3.0-or-later"),
    (("agpl_terms", "gpl_version3"), "AGPL-3.0-or-later"),
    (("agpl_terms_3",), "AGPL-3.0-or-later"),
    (("mpl2",), "MPL-2.0"),
    (("isc",), "ISC"),
    (("unlicense",), "Unlicense"),
    (("apache_title", "apache_terms"), "Apache-2.0"),
    (("gpl3_title", "gpl_body"), "GPL-3.0-only"),
    (("gpl2_title", "gpl_body"), "GPL-2.0-only"),
    (("cc0_title",), "CC0-1.0"),
    (("boost_grant",), "BSL-1.0"),
    (("zlib_as_is", "zlib_grant"), "Zlib"),
    (("epl2",), "EPL-2.0"),
)

#: Licences whose short names may follow a tag, fixed values of the published list.
TAGGED = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 "
    "EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 "
    "MS-PL NCSA OFL-1.1 PostgreSQL Python-2.0 Unlicense UPL-1.0 WTFPL Zlib"
).split()
TAG = "spdx license identifier"


def _tag(name: str) -> str:
    return f"{TAG} {name.lower().replace('-', ' ')}"


#: A tag's sentence is known by its licence; names without a suffix are old ones for that version only.
TAG_SENTENCES = tuple((f"tag_{n.lower()}", _tag(n)) for n in TAGGED) + tuple((f"tag_{n.lower()}", _tag(n.removesuffix("-only"))) for n in TAGGED if n.endswith("-only"))
KNOWN = sorted([(v, k) for k, v in SENTENCES.items()] + [(v, k) for k, v in MORE_SENTENCES + TAG_SENTENCES], key=lambda x: (-len(x[0]), x))
EVERY_RULE = (*RULES, *MORE_RULES, *(((f"tag_{n.lower()}",), n) for n in TAGGED))

#: What is stripped from line starts, and where sentences end: at blank lines, semicolons and
#: colons, and after stops (with closing marks) before white space.
MARKS = "(?m)^[^A-Za-z0-9\\n]+"
SPLIT = "\\n\\n+|[;:]+|[.!?]+[\"')\\]*]*(?=\\s|$)"
#: Every known sentence holds one of these.
HINTS = "(?i)licen|permi|copy|softw|redist|neither the name|version|in the hope|terms and cond|cc0"
#: A tag and its name are one sentence; a plus is an old sign for later versions.
TAGS, LATER = "(?i)SPDX-License-Identifier[ \\t]*:[ \\t(]*", "(?i)(identifier [A-Z]*GPL-[0-9.]+)[+]"
#: What normalising turns into one blank: all but ASCII letters, digits and dots inside words.
STRANGE, STOPS = "[^a-z0-9.]+", "\\.+( |$)"


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    alone = F.array(*(F.lit(v) for v, _ in KNOWN))
    text = F.regexp_replace(F.regexp_replace(text, TAGS, f"{TAG} "), LATER, "$1-or-later")
    plain = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), STRANGE, " "), STOPS, " "))
    raw = F.filter(F.split(F.regexp_replace(text, MARKS, ""), SPLIT), lambda s: s.rlike(HINTS) | F.contains(s, F.lit("\n")))
    # a known line keeps its own place among the joined ones
    lines = F.transform(raw, lambda s: F.transform(F.split(s, "\n"), plain))
    whole = F.transform(lines, lambda s: F.array_join(F.transform(s, lambda x: F.when(F.array_contains(alone, x), F.concat(F.lit("|"), x, F.lit("|"))).otherwise(x)), " "))
    sentences = F.transform(F.flatten(F.transform(whole, lambda s: F.split(s, "[|]"))), lambda s: F.concat(F.lit(" "), F.trim(s), F.lit(" ")))
    found = F.transform(sentences, lambda s: F.coalesce(*(F.when(F.contains(s, F.lit(f" {v} ")), F.lit(k)) for v, k in KNOWN)))
    return F.when(text.rlike(HINTS), F.filter(found, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def licenses(found: Column) -> Column:
    """The licences of a sequence of identifiers, by the ordered rules, without repeats."""
    joined = F.concat(F.lit("|"), F.array_join(F.transform(found, lambda x: F.concat(x, F.lit("|"))), ""))
    out = []
    for parts, name in EVERY_RULE:
        pattern = "|" + "|".join(parts) + "|"
        out.append(F.when(F.contains(joined, F.lit(pattern)), F.lit(name)))
        # taken sentences leave a mark that no rule names, so that others do not close up
        joined = F.replace(joined, F.lit(pattern), F.lit("|+|"))
    return F.array_sort(F.array_distinct(F.filter(F.array(*out), lambda x: x.isNotNull())))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentences and licenses (sorted, 'none' if there are none)."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), identifiers(F.col("text")).alias("found"))
    names = F.array_join(licenses(F.col("found")), ",")
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_sentences"),
        F.array_join("found", ",").alias("sentences"),
        F.when(names == "", F.lit("none")).otherwise(names).alias("licenses"),
    )


def oracle() -> str:
    """The same by DuckDB's SQL, with the same tables and the same joining of lines."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({i}, {quoted(v)}, {quoted(k)})" for i, (v, k) in enumerate(KNOWN))
    steps, chain = [], ["t0 AS MATERIALIZED (SELECT *, joined AS j0 FROM agg)"]
    for k, (parts, name) in enumerate(EVERY_RULE):
        pattern = quoted("|" + "|".join(parts) + "|")
        steps.append(f"CASE WHEN contains(j{k}, {pattern}) THEN {quoted(name)} END")
        chain.append(f"t{k + 1} AS (SELECT *, replace(j{k}, {pattern}, '|+|') AS j{k + 1} FROM t{k})")
    space = "[ \\t\\n\\x0B\\f\\r]"
    return f"""
WITH known(i, plain, name) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
tagged AS (SELECT r, regexp_replace(regexp_replace(text, {quoted(TAGS)}, '{TAG} ', 'g'), {quoted(LATER)}, '\\1-or-later', 'g') AS text FROM docs WHERE regexp_matches(text, {quoted(HINTS)})),
marked AS (SELECT r, regexp_replace(regexp_replace(text, {quoted(MARKS)}, '', 'g'), '[.!?]+["'')\\]*]*({space}|$)', chr(1) || '\\1', 'g') AS text FROM tagged),
cut AS (SELECT r, unnest(s) AS s, unnest(range(len(s))) AS nr FROM (SELECT r, regexp_split_to_array(text, '\\n\\n+|[;:]+|\\x01') AS s FROM marked)),
lines AS (SELECT r, nr, unnest(l) AS l, unnest(range(len(l))) AS line FROM (SELECT r, nr, string_split(s, chr(10)) AS l FROM cut WHERE regexp_matches(s, {quoted(HINTS)}) OR contains(s, chr(10)))),
norm AS (SELECT r, nr, line, trim(regexp_replace(regexp_replace(lower(l), {quoted(STRANGE)}, ' ', 'g'), {quoted(STOPS)}, ' ', 'g')) AS l FROM lines),
whole AS (SELECT r, nr, string_agg(CASE WHEN l IN (SELECT plain FROM known) THEN '|' || l || '|' ELSE l END, ' ' ORDER BY line) AS s FROM norm GROUP BY r, nr),
sent AS (SELECT row_number() OVER () AS k, * FROM (SELECT r, nr, unnest(p) AS s, unnest(range(len(p))) AS part FROM (SELECT r, nr, string_split(s, '|') AS p FROM whole)) WHERE trim(s) <> ''),
hits AS (SELECT r, nr, part, name FROM sent JOIN known ON contains(' ' || trim(s) || ' ', ' ' || plain || ' ') QUALIFY row_number() OVER (PARTITION BY k ORDER BY i) = 1),
lists AS (SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY nr, part) AS sentences, '|' || string_agg(name || '|', '' ORDER BY nr, part) AS joined FROM hits GROUP BY r),
agg AS (SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(sentences, '') AS sentences, coalesce(joined, '|') AS joined FROM docs LEFT JOIN lists USING (r)),
{", ".join(chain)}
SELECT doc_id, n_sentences, sentences,
  coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter([{", ".join(steps)}], lambda x: x IS NOT NULL))), ','), ''), 'none') AS licenses
FROM t{len(EVERY_RULE)}"""
