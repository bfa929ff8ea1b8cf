"""Recognises licences by their sentences and the order these stand in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices, normalised as by ``normal``, with identifiers.
SENTENCES = {
    "mit-name": "mit license",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is-mit": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "no-liability-mit": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-name": "apache license",
    "apache-licensed": "licensed under the apache license version 2 0",
    "apache-licensed-the": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl2-work": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-licensed": "licensed under the bsd license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc0-1": "licensed under cc0 1 0",
    "cc-by-work-4": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-work-4": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "apache-title": "apache license version 2 0 january 2004",
    "mpl-title": "mozilla public license version 2 0",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl-see": "see the gnu affero general public license for more details",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "bsd0-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "epl2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "cc-by-sa-work-4": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 or later",
    "spdx-gpl2": "spdx license identifier gpl 2 0 or later",
    "spdx-mpl": "spdx license identifier mpl 2 0",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "spdx-bsd2": "spdx license identifier bsd 2 clause",
    "spdx-isc": "spdx license identifier isc",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
}

#: Rules in order of preference: licence, rule, the sentences that must follow each other in this order.
RULES = (
    ("MIT", "text", ("mit-grant", "mit-notice", "as-is-mit", "no-liability-mit")),
    ("Apache-2.0", "header", ("apache-licensed-the", "apache-comply", "apache-copy", "apache-basis", "apache-see")),
    ("GPL-3.0-or-later", "header", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", "header", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("LGPL-2.1-or-later", "header", ("lgpl21-free", "lgpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", "header", ("lgpl3-free", "gpl-hope", "lgpl-see")),
    ("AGPL-3.0-or-later", "header", ("agpl3-free", "gpl-hope", "agpl-see")),
    ("BSD-3-Clause", "text", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", "text", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("ISC", "text", ("isc-grant",)),
    ("MPL-2.0", "header", ("mpl-form", "mpl-copy")),
    ("Zlib", "text", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", "text", ("boost-grant",)),
    ("0BSD", "text", ("bsd0-grant",)),
    ("EPL-2.0", "header", ("epl2",)),
    ("WTFPL", "text", ("wtfpl",)),
    ("GPL-3.0", "title", ("gpl3-title",)),
    ("GPL-2.0", "title", ("gpl2-title",)),
    ("LGPL-3.0", "title", ("lgpl3-title",)),
    ("AGPL-3.0", "title", ("agpl3-title",)),
    ("Apache-2.0", "title", ("apache-title",)),
    ("MPL-2.0", "title", ("mpl-title",)),
    ("MIT", "tag", ("spdx-mit",)),
    ("Apache-2.0", "tag", ("spdx-apache",)),
    ("GPL-3.0-or-later", "tag", ("spdx-gpl3",)),
    ("GPL-2.0-or-later", "tag", ("spdx-gpl2",)),
    ("MPL-2.0", "tag", ("spdx-mpl",)),
    ("BSD-3-Clause", "tag", ("spdx-bsd3",)),
    ("BSD-2-Clause", "tag", ("spdx-bsd2",)),
    ("ISC", "tag", ("spdx-isc",)),
    ("MIT", "notice", ("mit-released",)),
    ("MIT", "notice", ("mit-licensed",)),
    ("Apache-2.0", "notice", ("apache-licensed",)),
    ("Apache-2.0", "notice", ("apache-licensed-the",)),
    ("GPL-3.0-only", "notice", ("gpl3-work",)),
    ("GPL-2.0-only", "notice", ("gpl2-work",)),
    ("BSD-3-Clause", "notice", ("bsd-licensed",)),
    ("CC-BY-4.0", "notice", ("cc-by-4",)),
    ("CC-BY-4.0", "notice", ("cc-by-work-4",)),
    ("CC-BY-SA-4.0", "notice", ("cc-by-sa-4",)),
    ("CC-BY-SA-4.0", "notice", ("cc-by-sa-work-4",)),
    ("CC-BY-NC-4.0", "notice", ("cc-by-nc-4",)),
    ("CC-BY-NC-4.0", "notice", ("cc-by-nc-work-4",)),
    ("CC0-1.0", "notice", ("cc0-1",)),
    ("Unlicense", "notice", ("unlicense",)),
    ("all-rights-reserved", "notice", ("reserved",)),
)

#: A sentence may end at a blank line, after . ! ? ; : before white space, before a line in capitals or a link; a line
#: that ends none goes on in the next. Known sentences go over such places: see ``found_ids``.
SENTENCE_END = r"(?<=[.!?;:])\s+|\n\s*\n|\n(?=\s*[A-Z])|\s+(?=https?://)"
#: A known sentence, the longest first, that begins and ends where pieces do.
KNOWN = r"\| (" + "|".join(s.replace(" ", r"(?: \|)? ") for s in sorted(SENTENCES.values(), key=len, reverse=True)) + r") (?=\|)"
#: Every sentence above has one of these words, joined as ``normal`` joins them; a text with none is passed over.
CUE = r"(?i)licen[cs]e|permission|warranty|redistribution|liab|copyright|copy of|free software|public domain|rights reserved".replace(" ", r"[^\p{L}\p{N}]+")


def normal(sentence: Column) -> Column:
    """Letters and digits in lower case, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END, -1), normal), lambda s: s != "")


def found_ids(text: Column) -> Column:
    """Identifiers of the known sentences, in order: each is one piece of the text, or several next to each other."""
    known = F.create_map(*(F.lit(x) for name, s in SENTENCES.items() for x in (s, name)))
    joined = F.concat(F.lit("| "), F.array_join(sentences(text), " | "), F.lit(" |"))
    return F.transform(F.regexp_extract_all(joined, F.lit(KNOWN), F.lit(1)), lambda s: F.try_element_at(known, F.replace(s, F.lit(" |"), F.lit(""))))


def license_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of docs plus sentence_ids, licenses (sorted, distinct) and rules, one of each match.

    A text's sentences are normalised and looked up among known licence
    sentences; the identifiers found, in order, make a sequence (unknown sentences in
    between are passed over). A rule matches where its identifiers stand next to each
    other in that sequence. Rules are tried in order; what a rule has matched
    is taken out, so a notice within a header isn't reported again. ``rules`` has
    licence and rule joined by a colon, in order of preference, once for each match.

    Null and empty texts have none of them. Very long texts are scanned whole. Repeated rows are judged each, alike; an
    empty table gives no rows. Of sentences that begin at one place the longest counts, of rules the first in order.
    Input columns of the added names are replaced, others kept whatever their names. No row moves: the sentences and rules
    are constants of the plan, and each row is judged alone.
    """
    t = F.col(f"`{text_col}`")
    none = F.array().cast("array<string>")
    ids = F.when(t.rlike(CUE), found_ids(t)).otherwise(none)
    rows = docs.select(F.struct("*").alias("d"), F.coalesce(ids, none).alias("ids"))
    rows = rows.select("d", "ids", F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")).alias("left"))

    start = F.struct(F.col("left").alias("left"), none.alias("hits"))

    def step(s, r):
        times = F.regexp_count(s["left"], F.concat(F.lit(r"\Q"), r["seq"], F.lit(r"\E")))
        return F.struct(F.replace(s["left"], r["seq"], F.lit(" | ")).alias("left"), F.concat(s["hits"], F.array_repeat(r["name"], times)).alias("hits"))

    table = F.array(*(F.struct(F.lit(f"{lic}:{rule}").alias("name"), F.lit(" " + "  ".join(seq) + " ").alias("seq")) for lic, rule, seq in RULES))
    rows = rows.select("d", "ids", F.when(F.size("ids") == 0, none).otherwise(F.aggregate(table, start, step, lambda s: s["hits"])).alias("hits"))
    licenses = F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.substring_index(h, ":", 1))))
    kept = [F.col(f"d.`{c}`").alias(c) for c in docs.columns if c not in ("sentence_ids", "licenses", "rules")]
    return rows.select(*kept, F.col("ids").alias("sentence_ids"), licenses.alias("licenses"), F.col("hits").alias("rules"))
