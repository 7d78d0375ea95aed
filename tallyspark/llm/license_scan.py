"""License scan: known licence sentences, and ordered rules over the sequence in which they stand.

A text is normalised (A-Z lowered, everything but letters, digits and inner points to separators).  Line
ends and the marks ``.!?:;`` become line breaks, all else blanks.  A known sentence is met where it begins
and ends at a line break, whatever separates its words: titles, copyright lines, blank lines, comment
marks, list numbers and wraps stand between or in sentences without hiding them.  A sentence may have a
gap (``*``: one to twelve words) for a name.  The identifiers of a text, in order, form a sequence.  Rules are
tried in order, longer notices before the short ones they contain; a rule takes the sentences that it
has matched out of the sequence.  Known sentences of other rules may stand between those of a rule.
DataFrame functions only, one row per document, no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Known sentences of public licences and notices, normalised, by identifier.
SENTENCES = {
    "mit_line": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license",
                 "this work is licensed under the mit license", "spdx license identifier mit"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                  "documentation files the software to deal in the software without restriction including without limitation the "
                  "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
                  "persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
                   "the software"],
    "as_is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the "
              "warranties of merchantability fitness for a particular purpose and noninfringement"],
    "apache2_line": ["licensed under the apache license version 2.0", "released under the apache license version 2.0",
                     "this work is licensed under the apache license version 2.0", "spdx license identifier apache 2.0"],
    "apache2_notice": ["licensed under the apache license version 2.0 the license you may not use this file except in compliance with "
                       "the license"],
    "apache2_copy": ["you may obtain a copy of the license at http www.apache.org licenses license 2.0"],
    "gpl3_line": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license "
                  "version 3", "released under the gnu general public license version 3", "spdx license identifier gpl 3.0 only"],
    "gpl3_later": ["* is free software you can redistribute it and or modify it under the terms of the gnu general public "
                   "license as published by the free software foundation either version 3 of the license or at your option any later "
                   "version", "spdx license identifier gpl 3.0 or later"],
    "gpl_hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied "
                 "warranty of merchantability or fitness for a particular purpose"],
    "cc_by_line": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0",
                   "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc_by_nc_line": ["licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0",
                      "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc_by_sa_line": ["licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0",
                      "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the "
                  "following conditions are met"],
    "bsd_line": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following "
                   "disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
                   "disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_names": ["neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this "
                  "software without specific prior written permission",
                  "neither the name of * nor the names of * may be used to endorse or promote products derived from this software "
                  "without specific prior written permission",
                  "the name of * may not be used to endorse or promote products derived from this software without specific prior "
                  "written permission", "the names of * may not be used to endorse or promote products derived from this software "
                  "without specific prior written permission"],
    "bsd_ads": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd2_line": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license", "spdx license identifier bsd 2 clause"],
    "bsd_style_line": ["use of this source code is governed by a bsd style license that can be found in the license file"],
    "apache2_title": ["apache license version 2.0 january 2004"],
    "gpl3_title": ["gnu general public license version 3 29 june 2007"],
    "gpl2_title": ["gnu general public license version 2 june 1991"],
    "gpl2_line": ["licensed under the gnu general public license version 2", "released under the gnu general public license version 2",
                  "this work is licensed under the gnu general public license version 2", "spdx license identifier gpl 2.0 only",
                  "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                  "license version 2 as published by the free software foundation"],
    "gpl2_later": ["* is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
                   "published by the free software foundation either version 2 of the license or at your option any later version",
                   "spdx license identifier gpl 2.0 or later"],
    "lgpl3_title": ["gnu lesser general public license version 3 29 june 2007"],
    "lgpl3_later": ["* is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
                    "as published by the free software foundation either version 3 of the license or at your option any later version",
                    "spdx license identifier lgpl 3.0 or later"],
    "lgpl21_title": ["gnu lesser general public license version 2.1 february 1999"],
    "lgpl21_later": ["* is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
                     "as published by the free software foundation either version 2.1 of the license or at your option any later version",
                     "spdx license identifier lgpl 2.1 or later"],
    "agpl3_title": ["gnu affero general public license version 3 19 november 2007"],
    "agpl3_later": ["* is free software you can redistribute it and or modify it under the terms of the gnu affero general public license "
                    "as published by the free software foundation either version 3 of the license or at your option any later version",
                    "spdx license identifier agpl 3.0 or later"],
    "mpl2_title": ["mozilla public license version 2.0", "spdx license identifier mpl 2.0"],
    "mpl2_notice": ["this source code form is subject to the terms of the mozilla public license v 2.0"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
                  "provided that the above copyright notice and this permission notice appear in all copies",
                  "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted "
                  "provided that the above copyright notice and this permission notice appear in all copies", "spdx license identifier isc"],
    "zlib_grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it "
                   "and redistribute it freely subject to the following restrictions", "spdx license identifier zlib"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "spdx license identifier unlicense"],
    "bsl_title": ["boost software license version 1.0 august 17th 2003", "distributed under the boost software license version 1.0",
                  "spdx license identifier bsl 1.0"],
    "cc0_title": ["cc0 1.0 universal", "creative commons cc0 1.0 universal", "licensed under cc0 1.0", "spdx license identifier cc0 1.0"],
    "cc_by_title": ["creative commons attribution 4.0 international public license", "spdx license identifier cc by 4.0"],
    "cc_by_sa_title": ["creative commons attribution sharealike 4.0 international public license", "spdx license identifier cc by sa 4.0"],
    "cc_by_nc_title": ["creative commons attribution noncommercial 4.0 international public license", "spdx license identifier cc by nc 4.0"],
    "reserved": ["all rights reserved"],
}
#: Licences and the sentences that they need, in this order; the first that fit take their sentences.
LICENSES = [
    ("MIT", ["mit_grant", "mit_notice", "as_is"]), ("MIT", ["mit_grant", "as_is"]), ("MIT", ["mit_grant", "mit_notice"]),
    ("MIT", ["mit_grant"]), ("MIT", ["mit_line"]),
    ("Apache-2.0", ["apache2_title"]), ("Apache-2.0", ["apache2_notice", "apache2_copy"]), ("Apache-2.0", ["apache2_notice"]),
    ("Apache-2.0", ["apache2_line"]),
    # a licence file ends with the notice to use, which says nothing of the work itself
    ("AGPL-3.0", ["agpl3_title", "agpl3_later", "gpl_hope"]), ("AGPL-3.0-or-later", ["agpl3_later"]), ("AGPL-3.0", ["agpl3_title"]),
    ("LGPL-3.0-or-later", ["lgpl3_later"]), ("LGPL-3.0", ["lgpl3_title"]),
    ("LGPL-2.1", ["lgpl21_title", "lgpl21_later"]), ("LGPL-2.1-or-later", ["lgpl21_later"]), ("LGPL-2.1", ["lgpl21_title"]),
    ("GPL-3.0", ["gpl3_title", "gpl3_later", "gpl_hope"]),
    ("GPL-3.0-or-later", ["gpl3_later", "gpl_hope"]), ("GPL-3.0-or-later", ["gpl3_later"]), ("GPL-3.0-only", ["gpl3_line"]),
    ("GPL-3.0", ["gpl3_title"]),
    ("GPL-2.0", ["gpl2_title", "gpl2_later", "gpl_hope"]),
    ("GPL-2.0-or-later", ["gpl2_later", "gpl_hope"]), ("GPL-2.0-or-later", ["gpl2_later"]), ("GPL-2.0-only", ["gpl2_line"]),
    ("GPL-2.0", ["gpl2_title"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_line"]), ("CC-BY-NC-4.0", ["cc_by_nc_title"]), ("CC-BY-SA-4.0", ["cc_by_sa_line"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_title"]), ("CC-BY-4.0", ["cc_by_line"]), ("CC-BY-4.0", ["cc_by_title"]), ("CC0-1.0", ["cc0_title"]),
    ("BSD-4-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_ads", "bsd_names"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]), ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("BSD-3-Clause", ["bsd_grant"]), ("BSD-3-Clause", ["bsd_line"]), ("BSD-2-Clause", ["bsd2_line"]), ("BSD-style", ["bsd_style_line"]),
    ("MPL-2.0", ["mpl2_title"]), ("MPL-2.0", ["mpl2_notice"]), ("ISC", ["isc_grant"]), ("Zlib", ["zlib_grant"]),
    ("Unlicense", ["unlicense"]), ("BSL-1.0", ["bsl_title"]),
]
#: Ordered rules: the reservation in the copyright line above a licence belongs to that licence.
RULES = [*((name, [*head, *needed]) for name, needed in LICENSES for head in (["reserved"], [])), ("proprietary", ["reserved"])]
GAP = r"(?:[a-z0-9.]+[ \n]){1,12}?"


def normalised(text: Column) -> Column:
    """Words with a blank or, at a line end or a mark, a line break between them, and a line break around all."""
    broken = F.regexp_replace(F.translate(text, UPPER + "\r", LOWER + "\n"), r"[.!?:;](?![a-z0-9])", "\n")
    words = F.regexp_replace(broken, r"[^a-z0-9.\n]+", " ")
    return F.regexp_replace(F.concat(F.lit("\n"), words, F.lit("\n")), r" ?\n[ \n]*", "\n")


def pattern_of(sentence: str) -> str:
    words = "".join(GAP if w == "*" else re.escape(w) + r"[ \n]" for w in sentence.split())
    return words.removesuffix(r"[ \n]")


def sentence_ids(text: Column, known: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order; null and empty texts have none."""
    forms = sorted(known, key=len, reverse=True)
    if not forms:
        return F.array().cast("array<string>")
    # the number of a list item may stand before a sentence
    pattern = r"\n(?:(?:[0-9]{1,2}|[a-z]|[ivx]{1,4}) )?(" + "|".join(map(pattern_of, forms)) + r")(?=\n)"
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])

    def ident(found: Column) -> Column:
        plain = F.translate(found, "\n", " ")
        return F.coalesce(F.try_element_at(table, plain), *[F.when(F.regexp_like(plain, F.lit(f"^{pattern_of(f)}$")), F.lit(known[f]))
                                                            for f in forms if "*" in f.split()])

    found = F.regexp_extract_all(normalised(text), F.lit(pattern), F.lit(1))
    return F.coalesce(F.transform(found, ident), F.array().cast("array<string>"))


def match_rules(sequence: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Names of the licences whose rules are met, each tried after the ones before it took their sentences.

    A rule whose sentences are all there is followed along the sequence by a counter, one step per sentence: time is
    linear in the sequence.  No rule needs a sentence twice, so a repeat behind its like is left out first."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, needed)).alias("needed")) for name, needed in rules])
    fresh = F.filter(sequence, lambda x, i: (i == 0) | (F.get(sequence, i - 1) != x))
    start = F.struct(fresh.alias("rest"), F.array_distinct(sequence).alias("present"), F.array().cast("array<string>").alias("names"))

    def tried(state: Column, rule: Column) -> Column:
        needed = rule["needed"]
        there = F.forall(needed, lambda x: F.array_contains(state["present"], x))
        passed = F.aggregate(state["rest"], F.lit(0), lambda at, x: F.when(F.get(needed, at) == x, at + 1).otherwise(at))
        met = F.when(there, (F.size(needed) == 1) | (passed == F.size(needed))).otherwise(F.lit(False))
        return F.struct(F.when(met, F.filter(state["rest"], lambda x: ~F.array_contains(needed, x))).otherwise(state["rest"]).alias("rest"),
                        F.when(met, F.array_except(state["present"], needed)).otherwise(state["present"]).alias("present"),
                        F.when(met, F.array_append(state["names"], rule["name"])).otherwise(state["names"]).alias("names"))

    return F.array_distinct(F.aggregate(table, start, tried, lambda state: state["names"]))


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sentences: dict[str, list[str]] | None = None,
                  rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """A row per row of ``docs`` and licence found: ``doc_id, license, n_sentences`` (known sentences of the
    text in all).  A text without known sentences, null and empty ones included, gives no row; null
    ids stay null; repeated rows repeat; an empty table gives an empty result."""
    known = {s: ident for ident, forms in (sentences or SENTENCES).items() for s in forms}
    rules = rules or RULES
    found = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), sentence_ids(F.col(f"`{text}`").cast("string"), known).alias("ids"))
    found = found.where(F.size("ids") > 0)
    names = match_rules(F.col("ids"), rules)
    return found.select("doc_id", F.explode(names).alias("license"), F.size("ids").cast("long").alias("n_sentences"))
