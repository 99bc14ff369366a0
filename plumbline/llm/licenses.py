"""License scans by sentence rules.

A text is cut into sentences twice: across its lines (after marks that end a sentence, colons at a line's end
or after words that lead to a list, and blank lines), so that hard-wrapped notices are whole, and at every line
end too, so that a line without a mark is one. The dot of a company's form (`Acme Inc. nor`) ends no sentence where
a small letter or a word such as AND follows. Normalised sentences (lower case, words of letters, digits, `.`, `+` and `-` only, without
the number, letter or dash of a list before them) that are known get their identifier; so do those with a phrase of
`FAMILIES`, whoever's name stands in them. A document's identifiers are those of the first cut in order, and after
a gap those of the second that the first has not. They are matched against the rules in order, each a run of
identifiers. A rule takes the identifiers that it matches, wherever they stand, so that a later and shorter rule
sees what is left; no rule matches across the gap. A rule doesn't hold where one of its `UNLESS` stands anywhere:
a licence with a clause more is rather unmatched than taken for a shorter one.

Null and empty texts have none. Repeated rows each get their result. Further columns, of any name, are neither
read nor returned. Texts without any of `ANCHORS` are not cut: every known sentence has one of them, as they
are chosen from the sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

ACROSS = r"[.;!?]+(?:[ \t\r\n]+|$)|:[ \t\r]*\n|\n[ \t\r#*/;]*\n"
LINES = r"[.;!?]+(?:[ \t\r\n]+|$)|[\r\n]+"
# Forms of companies whose dot ends no sentence, and words whose colon leads to a list.
FORMS, LEADS = "Inc|Ltd|Co|Corp|LLC|Bros", "conditions|following|met"
#: What is replaced before a text is cut, and what is taken from the beginning of a normalised sentence.
TIDY = [
    (rf"(^|[^A-Za-z])({FORMS})[.]([ \t\r\n#*/;]+[a-z(])", r"{1}{2}{3}"),
    (rf"(^|[^A-Za-z])({FORMS.upper()})[.]([ \t\r\n#*/;]+(?:AND|OR|NOR|AS)[^A-Za-z])", r"{1}{2}{3}"),
    (rf"(^|[^A-Za-z])({LEADS}|{LEADS.upper()}):", r"{1}{2}."),
]
MARK = "^(?:(?:[-+.]+|[a-z]|[ivx]{1,4}|[0-9]{1,2}[.]?) )+"
# Normalised sentences of licence texts and notices, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "apache2-short",
    "licensed under the apache license version 2.0 the license": "apache2-notice",
    "you may not use this file except in compliance with the license": "apache2-use",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies": "mit-notice",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "this software is provided as is without warranty of any kind": "no-warranty",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "no-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc-liability",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used": "bsd-names",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl3-short",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl21-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "this library is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-fitness",
    "see the gnu general public license for more details": "gpl-details",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "mpl2-copy",
    "distributed under the boost software license version 1.0": "bsl1-short",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by-nc 4.0": "ccbync4-short",
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license": "ccbync4-long",
    "licensed under cc by 4.0": "ccby4-short",
    "this work is licensed under a creative commons attribution 4.0 international license": "ccby4-long",
    "licensed under cc by-sa 4.0": "ccbysa4-short",
    "this work is licensed under a creative commons attribution-sharealike 4.0 international license": "ccbysa4-long",
    "this work is in the public domain": "pd-short",
    "all rights reserved": "reserved",
    "copyright all rights reserved": "reserved",
    "spdx-license-identifier mit": "mit-spdx",
    "spdx-license-identifier isc": "isc-spdx",
    "spdx-license-identifier apache-2.0": "apache2-spdx",
    "spdx-license-identifier bsd-2-clause": "bsd2-spdx",
    "spdx-license-identifier bsd-3-clause": "bsd3-spdx",
    "spdx-license-identifier gpl-2.0-or-later": "gpl2-spdx",
    "spdx-license-identifier gpl-3.0-only": "gpl3-spdx",
    "spdx-license-identifier mpl-2.0": "mpl2-spdx",
}
# Phrases of sentences that come with many names in them, and their identifiers.
FAMILIES = {
    "endorse or promote products": "bsd-names",
    "advertising materials mentioning": "bsd-advert",
    "^this software is provided by .* as is and any express or implied warranties": "bsd-warranty",
    "^the software shall be used for good not evil$": "json-good",
    "^except as contained in this notice the name": "x11-names",
}
# Identifiers beside which rules of a licence don't hold.
UNLESS = {"BSD-2-Clause": ("bsd-names", "bsd-advert"), "BSD-3-Clause": ("bsd-advert",), "MIT": ("json-good", "x11-names")}
# Fixed values, in the order in which they are tried: the identifiers that stand together, and the licence.
RULES = [
    (("apache2-notice", "apache2-use", "apache2-warranty", "apache2-see"), "Apache-2.0"),
    (("apache2-notice", "apache2-use"), "Apache-2.0"),
    (("mit-grant", "mit-notice", "json-good", "no-warranty", "mit-liability"), "JSON"),
    (("mit-grant", "mit-notice", "no-warranty", "mit-liability", "x11-names"), "X11"),
    (("mit-grant", "mit-notice", "no-warranty", "mit-liability"), "MIT"),
    (("mit-grant", "mit-notice", "no-warranty"), "MIT"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("isc-grant", "isc-warranty", "isc-liability"), "ISC"),
    (("isc-grant",), "ISC"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names", "bsd-warranty"), "BSD-4-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-names"), "BSD-3-Clause"),
    (("bsd-grant",), "LicenseRef-BSD"),
    (("gpl3-later", "gpl-warranty", "gpl-fitness", "gpl-details", "gpl-copy"), "GPL-3.0"),
    (("gpl2-later", "gpl-warranty", "gpl-fitness", "gpl-details", "gpl-copy"), "GPL-2.0"),
    (("gpl3-later", "gpl-warranty", "gpl-fitness"), "GPL-3.0"),
    (("gpl2-later", "gpl-warranty", "gpl-fitness"), "GPL-2.0"),
    (("agpl3-later", "gpl-warranty", "gpl-fitness"), "AGPL-3.0"),
    (("lgpl21-later", "gpl-warranty", "gpl-fitness"), "LGPL-2.1"),
    (("gpl3-grant", "gpl-warranty"), "GPL-3.0"),
    (("gpl3-later",), "GPL-3.0"),
    (("gpl2-later",), "GPL-2.0"),
    (("agpl3-later",), "AGPL-3.0"),
    (("lgpl21-later",), "LGPL-2.1"),
    (("mpl2-subject", "mpl2-copy"), "MPL-2.0"),
    (("mpl2-subject",), "MPL-2.0"),
    (("bsl1-short",), "BSL-1.0"),
    (("unlicense",), "Unlicense"),
    (("mit-grant",), "MIT"),
    (("gpl3-grant",), "GPL-3.0"),
    (("apache2-notice",), "Apache-2.0"),
    (("apache2-short",), "Apache-2.0"),
    (("apache2-spdx",), "Apache-2.0"),
    (("mit-short",), "MIT"),
    (("mit-spdx",), "MIT"),
    (("isc-spdx",), "ISC"),
    (("bsd2-spdx",), "BSD-2-Clause"),
    (("bsd3-spdx",), "BSD-3-Clause"),
    (("gpl3-short",), "GPL-3.0"),
    (("gpl3-spdx",), "GPL-3.0"),
    (("gpl2-spdx",), "GPL-2.0"),
    (("mpl2-spdx",), "MPL-2.0"),
    (("ccbync4-short",), "CC-BY-NC-4.0"),
    (("ccbync4-long",), "CC-BY-NC-4.0"),
    (("ccby4-short",), "CC-BY-4.0"),
    (("ccby4-long",), "CC-BY-4.0"),
    (("ccbysa4-short",), "CC-BY-SA-4.0"),
    (("ccbysa4-long",), "CC-BY-SA-4.0"),
    (("pd-short",), "Public-Domain"),
    (("reserved",), "Proprietary"),
]


def anchors(keys: list[str], at_least: int = 6) -> list[str]:
    """Runs of at least so many letters of which every key has one: again and again the one that most keys have."""
    left, out = [{w for w in re.findall("[a-z]+", k) if len(w) >= at_least} for k in keys], []
    while left:
        if not all(left):
            raise ValueError("a known sentence has no long word")
        n = Counter(w for words in left for w in words)
        out.append(min(n, key=lambda w: (-n[w], w)))
        left = [words for words in left if out[-1] not in words]
    return out


ANCHORS = anchors([*SENTENCES, *FAMILIES])
ANCHOR = "|".join(ANCHORS)


def sentences(text: Column, cut: str) -> Column:
    """array<string> of normalised sentences."""
    plain = lambda s: F.regexp_replace(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9.+-]+", " ")), r"[ .]+$", "")
    return F.transform(F.split(text, cut), lambda s: F.regexp_replace(plain(s), MARK, ""))


def identified(text: Column, cut: str) -> Column:
    """array<string> of the identifiers of known sentences, in order."""
    for pattern, put in TIDY:
        text = F.regexp_replace(text, pattern, put.replace("{", "$").replace("}", ""))
    names = F.create_map(*[F.lit(x) for item in SENTENCES.items() for x in item])
    family = lambda s: F.coalesce(*[F.when(s.rlike(phrase), i) for phrase, i in FAMILIES.items()])
    return F.filter(F.transform(sentences(text, cut), lambda s: F.coalesce(F.element_at(names, s), family(s))), lambda i: i.isNotNull())


def matched(sequence: Column) -> tuple[Column, Column]:
    """Of identifiers as ` a  b `: the licences by the rules in order, and what no rule took."""
    licences = []
    whole = sequence
    for ids, licence in RULES:
        run = F.lit("".join(f" {i} " for i in ids))
        if others := UNLESS.get(licence):
            beside = reduce(or_, [F.contains(whole, F.lit(f" {other} ")) for other in others])
            run = F.when(beside, "\0").otherwise(run)  # which is in no sequence
        licences.append(F.when(F.contains(sequence, run), F.lit(licence)))
        sequence = F.replace(sequence, run, F.lit("  "))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*licences)))), sequence


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, identifiers (space-joined), n_sentences that were known, licences (comma-joined), n_unmatched."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    none = F.array().cast("array<string>")
    marked = F.lower("text").rlike(ANCHOR)
    rows = rows.select("doc_id", *[F.when(marked, identified(F.col("text"), cut)).otherwise(none).alias(name) for name, cut in (("across", ACROSS), ("lines", LINES))])
    rows = rows.select("doc_id", "across", F.filter("lines", lambda i: ~F.array_contains("across", i)).alias("lines"))
    led = lambda ids: F.array_join(F.transform(ids, lambda i: F.concat(F.lit(" "), i, F.lit(" "))), "")
    rows = rows.select("doc_id", F.concat("across", "lines").alias("ids"), F.concat(led("across"), F.lit("|"), led("lines")).alias("sequence"))
    licences, rest = matched(F.col("sequence"))
    left = F.size(F.filter(F.split(F.replace(rest, F.lit("|"), F.lit("")), " "), lambda x: x != ""))
    return rows.select("doc_id", F.array_join("ids", " ").alias("identifiers"), F.size("ids").cast("long").alias("n_sentences"), F.array_join(licences, ",").alias("licences"), left.cast("long").alias("n_unmatched"))


def scan_sql() -> str:
    """The same as scan() over documents, in DuckDB's SQL."""
    names = ", ".join(f"'{s}': '{i}'" for s, i in SENTENCES.items())
    family = " ".join(f"WHEN regexp_matches(s, '{phrase}') THEN '{i}'" for phrase, i in FAMILIES.items())
    licences = [("".join(f" {i} " for i in ids), licence) for ids, licence in RULES]
    tries = ["s0 AS (SELECT *, sequence AS q, []::VARCHAR[] AS found FROM ids)"]
    for k, (run, licence) in enumerate(licences, 1):
        holds = " AND ".join([f"contains(q, '{run}')", *[f"NOT contains(sequence, ' {other} ')" for other in UNLESS.get(licence, ())]])
        tries.append(f"s{k} AS (SELECT * REPLACE (CASE WHEN {holds} THEN replace(q, '{run}', '  ') ELSE q END AS q, CASE WHEN {holds} THEN list_append(found, '{licence}') ELSE found END AS found) FROM s{k - 1})")
    tidied = "text"
    for pattern, put in TIDY:
        tidied = f"regexp_replace({tidied}, '{pattern}', '{put.replace('{', chr(92)).replace('}', '')}', 'g')"
    plain = "regexp_replace(regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9.+-]+', ' ', 'g')), '[ .]+$', ''), '" + MARK + "', '')"
    known = lambda cut: f"list_filter(list_transform(list_transform(regexp_split_to_array(text, '{cut}'), lambda s: {plain}), lambda s: coalesce((MAP {{{names}}})[s], CASE {family} END)), lambda i: i IS NOT NULL)"
    led = lambda ids: f"coalesce(list_aggregate(list_transform({ids}, lambda i: ' ' || i || ' '), 'string_agg', ''), '')"
    return f"""
    WITH marked AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{ANCHOR}') THEN {tidied} ELSE '' END AS text FROM documents),
    named AS (SELECT doc_id, {known(ACROSS)} AS across, {known(LINES)} AS lines FROM marked),
    apart AS (SELECT doc_id, across, list_filter(lines, lambda i: NOT list_contains(across, i)) AS lines FROM named),
    ids AS (SELECT doc_id, list_concat(across, lines) AS ids, {led("across")} || '|' || {led("lines")} AS sequence FROM apart),
    {", ".join(tries)}
    SELECT doc_id, coalesce(list_aggregate(ids, 'string_agg', ' '), '') AS identifiers, len(ids)::BIGINT AS n_sentences,
        coalesce(list_aggregate(list_sort(list_distinct(found)), 'string_agg', ','), '') AS licences,
        len(list_filter(string_split(replace(q, '|', ''), ' '), lambda x: x <> ''))::BIGINT AS n_unmatched
    FROM s{len(licences)}"""
