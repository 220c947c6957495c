r"""License scans by sentence rules (native DataFrame operations only).

Known licence sentences have identifiers.  A text is normalised: lower case, wrapped
lines joined, everything but letters and digits to single blanks, sentences ended by
``.`` or ``;`` (not before a digit) and by lines without a letter or digit.  A
sentence gives the identifiers of the known sentences that it is or holds, from left
to right; where several start at one word, the longest counts, and none reaches into
another.  Licence rules are ordered lists of identifiers and are matched against the
text's list of identifiers from left to right; where several match at one place, the
one of most identifiers counts, and its identifiers are used up.

Everything is an expression over one row: no shuffle.  Texts without any licence word
skip the work, which cannot change the result, since every rule has an identifier all
of whose sentences hold such a word.

Defined results: null and empty texts and texts without a match give no row;
repeated rows give repeated rows; a null doc_id is kept; other columns are not read.
Letters beyond A-Z part words, like any other character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table

#: Known sentences of licence notices and licence texts, normalised, by identifier.
KNOWN = {
    "apache_notice": ("licensed under the apache license version 2 0", "licensed under the apache license 2 0", "licensed under the apache 2 0 license", "released under the apache license version 2 0"),
    "apache_comply": ("you may not use this file except in compliance with the license",),
    "apache_copy": ("you may obtain a copy of the license at",),
    "apache_basis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "apache_title": ("apache license version 2 0 january 2004",),
    "mit_notice": ("licensed under the mit license", "released under the mit license", "distributed under the mit license", "available under the mit license"),
    "mit_grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",),
    "mit_keep": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "as_is": ("the software is provided as is without warranty of any kind express or implied",),
    "isc_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "isc_warranty": ("the software is provided as is and the author disclaims all warranties with regard to this software",),
    "boost_grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",),
    "boost_title": ("boost software license version 1 0",),
    "gpl3_notice": ("licensed under the gnu general public license version 3", "licensed under the gnu general public license v3", "licensed under the gnu gpl version 3", "licensed under the gplv3"),
    "gpl2_notice": ("licensed under the gnu general public license version 2", "licensed under the gnu general public license v2", "licensed under the gnu gpl version 2", "licensed under the gplv2"),
    "gpl3_title": ("gnu general public license version 3 29 june 2007",),
    "gpl2_title": ("gnu general public license version 2 june 1991",),
    "lgpl3_title": ("gnu lesser general public license version 3 29 june 2007",),
    "lgpl21_title": ("gnu lesser general public license version 2 1 february 1999",),
    "agpl3_title": ("gnu affero general public license version 3 19 november 2007",),
    "gpl_terms": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",),
    "lgpl_terms": ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",),
    "agpl_terms": ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",),
    "v2_later": ("either version 2 of the license or at your option any later version",),
    "v21_later": ("either version 2 1 of the license or at your option any later version",),
    "v3_later": ("either version 3 of the license or at your option any later version",),
    "v2_only": ("version 2 of the license",),
    "v21_only": ("version 2 1 of the license",),
    "v3_only": ("version 3 of the license",),
    "bsd3_notice": ("licensed under the bsd 3 clause license",),
    "bsd2_notice": ("licensed under the bsd 2 clause license",),
    "bsd_use": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd_endorse": ("may be used to endorse or promote products derived from this software without specific prior written permission",),
    "mpl2_notice": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "mpl2_copy": ("if a copy of the mpl was not distributed with this file you can obtain one at",),
    "zlib_warranty": ("this software is provided as is without any express or implied warranty",),
    "zlib_grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",),
    "cc_by_notice": ("licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"),
    "cc_by_sa_notice": ("licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc_by_nc_notice": ("licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "unlicense_grant": ("anyone is free to copy modify publish use compile sell or distribute this software",),
}
SENTENCES = {sentence: name for name, several in KNOWN.items() for sentence in several}
#: Ordered rules, the licence each one proves and its family.
RULES = (
    ("apache_notice apache_comply apache_copy apache_basis", "Apache-2.0", "permissive"),
    ("apache_notice apache_comply apache_copy", "Apache-2.0", "permissive"),
    ("apache_notice", "Apache-2.0", "permissive"),
    ("apache_title", "Apache-2.0", "permissive"),
    ("mit_grant mit_keep as_is", "MIT", "permissive"),
    ("mit_grant mit_keep", "MIT", "permissive"),
    ("mit_grant", "MIT", "permissive"),
    ("mit_notice", "MIT", "permissive"),
    ("isc_grant isc_warranty", "ISC", "permissive"),
    ("isc_grant", "ISC", "permissive"),
    ("boost_title boost_grant", "BSL-1.0", "permissive"),
    ("boost_grant", "BSL-1.0", "permissive"),
    ("gpl3_notice", "GPL-3.0", "copyleft"),
    ("gpl2_notice", "GPL-2.0", "copyleft"),
    ("gpl3_title", "GPL-3.0", "copyleft"),
    ("gpl2_title", "GPL-2.0", "copyleft"),
    ("lgpl3_title", "LGPL-3.0", "weak copyleft"),
    ("lgpl21_title", "LGPL-2.1", "weak copyleft"),
    ("agpl3_title", "AGPL-3.0", "copyleft"),
    ("gpl_terms v3_later", "GPL-3.0-or-later", "copyleft"),
    ("gpl_terms v2_later", "GPL-2.0-or-later", "copyleft"),
    ("gpl_terms v3_only", "GPL-3.0-only", "copyleft"),
    ("gpl_terms v2_only", "GPL-2.0-only", "copyleft"),
    ("gpl_terms", "GPL", "copyleft"),
    ("lgpl_terms v3_later", "LGPL-3.0-or-later", "weak copyleft"),
    ("lgpl_terms v21_later", "LGPL-2.1-or-later", "weak copyleft"),
    ("lgpl_terms v3_only", "LGPL-3.0-only", "weak copyleft"),
    ("lgpl_terms v21_only", "LGPL-2.1-only", "weak copyleft"),
    ("lgpl_terms", "LGPL", "weak copyleft"),
    ("agpl_terms v3_later", "AGPL-3.0-or-later", "copyleft"),
    ("agpl_terms", "AGPL", "copyleft"),
    ("bsd_use bsd_source bsd_binary bsd_endorse", "BSD-3-Clause", "permissive"),
    ("bsd_use bsd_source bsd_binary", "BSD-2-Clause", "permissive"),
    ("bsd_source bsd_binary bsd_endorse", "BSD-3-Clause", "permissive"),
    ("bsd_source bsd_binary", "BSD", "permissive"),
    ("bsd3_notice", "BSD-3-Clause", "permissive"),
    ("bsd2_notice", "BSD-2-Clause", "permissive"),
    ("mpl2_notice mpl2_copy", "MPL-2.0", "weak copyleft"),
    ("mpl2_notice", "MPL-2.0", "weak copyleft"),
    ("zlib_warranty zlib_grant", "Zlib", "permissive"),
    ("cc_by_nc_notice", "CC-BY-NC-4.0", "non-commercial"),
    ("cc_by_sa_notice", "CC-BY-SA-4.0", "copyleft"),
    ("cc_by_notice", "CC-BY-4.0", "permissive"),
    ("unlicense unlicense_grant", "Unlicense", "public domain"),
    ("unlicense", "Unlicense", "public domain"),
)
#: Every rule has an identifier all of whose sentences hold one of these.
MARK = "(?i)licen[cs]e|permission|redistribut|unencumbered"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ|", "abcdefghijklmnopqrstuvwxyz "
NUMBER = "[.;]([ \t\n\r]*[0-9])"
END = "[.;]|\n[^a-z0-9\n]*\n"
OTHER = "[^a-z0-9|]+"


def normalised(text: Column) -> Column:
    """The text's words between single blanks, its sentences parted by ``|``."""
    low = F.regexp_replace(F.translate(text, UPPER, LOWER), NUMBER, " $1")
    return F.regexp_replace(F.regexp_replace(low, END, "|"), OTHER, " ")


def _any_of(names: list[str]) -> str:
    """Expression of whole names, the one of most words first (then the longest) where several start at one place."""
    return r"\b(?:" + "|".join(sorted(names, key=lambda s: (-len(s.split()), -len(s), s))) + r")\b"


def _looked_up(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def identifiers(text: Column, known: dict[str, str] = SENTENCES) -> Column:
    """The known sentences' identifiers in the text's order, joined by blanks."""
    found = F.regexp_extract_all(normalised(text), F.lit(_any_of(list(known))), F.lit(0))
    return F.when(text.rlike(MARK), F.array_join(F.transform(found, lambda s: F.try_element_at(_looked_up(known), s)), " ")).otherwise(F.lit(""))


def scan(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """doc_id, licenses (sorted, distinct), families and n_matches of the documents with a match."""
    out = docs.select("doc_id", identifiers(F.col("text"), known).alias("ids")).where("ids <> ''")
    out = out.select("doc_id", F.regexp_extract_all("ids", F.lit(_any_of([r for r, _, _ in rules])), F.lit(0)).alias("got")).where("size(got) > 0")

    def names(n: int) -> Column:
        value = _looked_up({r[0]: r[n] for r in rules})
        return F.array_join(F.array_sort(F.array_distinct(F.transform("got", lambda x: F.try_element_at(value, x)))), ",")

    return out.select("doc_id", names(1).alias("licenses"), names(2).alias("families"), F.size("got").cast("long").alias("n_matches"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def sql() -> str:
    """DuckDB SQL of the query: the same words, identifiers and rules by joins with their lists."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in SENTENCES.items())
    rules = ", ".join(f"({quote(r)}, {quote(x)}, {quote(f)})" for r, x, f in RULES)
    return f"""
WITH known(s, i) AS (VALUES {known}), rules(r, l, f) AS (VALUES {rules}),
t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '{NUMBER}', ' \\1', 'g') AS t FROM documents),
w AS (SELECT rid, doc_id, regexp_replace(regexp_replace(t, '{END}', '|', 'g'), '{OTHER}', ' ', 'g') AS t FROM t),
s AS (SELECT rid, doc_id, regexp_extract_all(t, '{_any_of(list(SENTENCES))}') AS parts FROM w),
p AS (SELECT rid, doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS pos FROM s),
k AS (SELECT rid, doc_id, string_agg(i, ' ' ORDER BY pos) AS ids FROM p JOIN known USING (s) GROUP BY rid, doc_id),
g AS (SELECT rid, doc_id, unnest(regexp_extract_all(ids, '{_any_of([r[0] for r in RULES])}')) AS r FROM k)
SELECT doc_id, string_agg(DISTINCT l, ',' ORDER BY l) AS licenses, string_agg(DISTINCT f, ',' ORDER BY f) AS families, count(*)::BIGINT AS n_matches
FROM g JOIN rules USING (r) GROUP BY rid, doc_id
"""


SQL = sql()
