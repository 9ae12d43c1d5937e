"""License scans by sentence rules, in DataFrame functions alone.

Texts are cut into sentences and normalised: lower case, every run of other characters
than letters and digits one blank. A sentence that is known has a number of a table of
licence sentences. The numbers of a text in order are matched against rules, each an
ordered list of sentences that may have others between them; a rule that another
matched rule contains does not count. Both tables are arguments. Lines with an SPDX tag
name their licences themselves. Everything happens within the row of a text, so nothing is
shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of well-known licences, normalised.
SENTENCES = {
    "mit-release": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-short": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-licensed": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-program": "this program is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl3-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl-free": "this library is free software",
    "lgpl21-redistribute": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

# Rules: licence, and its sentences in order.
RULES = [
    ("MIT", ["mit-release"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-title-short", "mit-grant", "mit-notice", "as-is"]),
    ("Apache-2.0", ["apache-licensed"]),
    ("Apache-2.0", ["apache-header", "apache-use", "apache-copy", "apache-warranty"]),
    ("Apache-2.0", ["apache-header", "apache-use"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("GPL-3.0-only", ["gpl3-program"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-redistribute", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl3-redistribute"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-redistribute", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl21-redistribute"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-4.0", ["cc-by-4-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
]

# Further sentences and rules of the default table. One "*" in a sentence stands for any words.
MORE_SENTENCES = {
    "apache-at": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-url-s": "https www apache org licenses license 2 0",
    "bsd-neither": "neither the name of * may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-nor": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-name": "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names": "the names of * may not be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl2-terms": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "gpl2-only-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    "gpl3-only-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license",
    "gpl2-program": "this program is licensed under the gnu general public license version 2",
    "gpl2-work": "this work is licensed under the gnu general public license version 2",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl3-redistribute": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "agpl3-redistribute": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "version-2": "version 2 of the license",
    "version-3": "version 3 of the license",
    "version-2-later": "either version 2 of the license or at your option any later version",
    "version-21-later": "either version 2 1 of the license or at your option any later version",
    "version-3-later": "either version 3 of the license or at your option any later version",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at *",
    "epl2-v-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which * available at *",
    "epl1-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at *",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-distributed": "distributed under the boost software license version 1 0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "busl-title": "business source license 1 1",
    "cc-by-sa-4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}
# Sentences of a rule that is a tuple have no other known ones between them.
MORE_RULES = [
    ("Apache-2.0", ["apache-header", "apache-use", "apache-at", "apache-url", "apache-warranty"]),
    ("Apache-2.0", ["apache-header", "apache-use", "apache-at", "apache-url-s", "apache-warranty"]),
    *[
        ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", name])
        for name in ("bsd-neither", "bsd-nor", "bsd-name", "bsd-names")
    ],
    ("GPL-2.0-or-later", ("gpl-terms", "version-2-later")),
    ("GPL-2.0-only", ("gpl-terms", "version-2")),
    ("GPL-2.0-only", ["gpl2-terms"]),
    ("GPL-2.0-only", ["gpl2-only-redistribute"]),
    ("GPL-2.0-only", ["gpl2-program"]),
    ("GPL-2.0-only", ["gpl2-work"]),
    ("GPL-3.0-or-later", ("gpl-terms", "version-3-later")),
    ("GPL-3.0-only", ("gpl-terms", "version-3")),
    ("GPL-3.0-only", ["gpl3-terms"]),
    ("GPL-3.0-only", ["gpl3-only-redistribute"]),
    ("LGPL-2.1-or-later", ("lgpl-terms", "version-21-later")),
    ("LGPL-3.0-or-later", ("lgpl-terms", "version-3-later")),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute"]),
    ("AGPL-3.0-or-later", ("agpl-terms", "version-3-later")),
    ("AGPL-3.0-or-later", ["agpl3-redistribute"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("EPL-2.0", ["epl2-v-terms"]),
    ("EPL-1.0", ["epl1-terms"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-distributed"]),
    ("BSL-1.0", ["boost-grant"]),
    ("BUSL-1.1", ["busl-title"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-work"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-work"]),
]
DEFAULT_SENTENCES = {**SENTENCES, **MORE_SENTENCES}
DEFAULT_RULES = [*RULES, *MORE_RULES]

# A line "SPDX-License-Identifier: (MIT OR Apache-2.0)" names its licences itself.
SPDX_TAG = "spdx-license-identifier:"
SPDX_LINE = (
    r"(?i)spdx-license-identifier:([ \t(]*[a-z0-9][a-z0-9.+:-]*(?:[ \t]*\))*"
    r"(?:[ \t]*(?:and|or|with)[ \t(]+[a-z0-9][a-z0-9.+:-]*(?:[ \t]*\))*)*)"
)
SPDX_OLD = {
    f"{name}{old}": f"{name}-{new}"
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
    for old, new in (("", "only"), ("+", "or-later"))
}

# A sentence ends at a sign before white space or the text's end. It also ends at a line
# end, as that of a header does, or else at an empty line only, as in wrapped paragraphs:
# a text is read both ways at once, and the known sentences of both count.
LINES = r"[.!?;:]\s|[.!?;:]$|\n"
PARAGRAPHS = r"[.!?;:]\s|[.!?;:]$|\n\n"
OTHER = "[^a-z0-9]+"


def contained(short: Sequence[str], long: Sequence[str]) -> bool:
    """Whether the sentences of a rule are, in order, among those of another."""
    rest = iter(long)
    return len(short) < len(long) and all(name in rest for name in short)


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(sentence, OTHER, " "))


def sentence_ids(text: Column, sentences: dict[str, str]) -> Column:
    """Numbers, places in the table from one, of the known sentences in order of the text.

    Ends of PARAGRAPHS are ends of LINES too, so a sentence between the former holds whole
    lines. It gives the numbers of its known lines and, where no line has it, its own first.
    """
    whole_ones = {s: k for k, s in reversed([*enumerate(sentences.values(), 1)]) if "*" not in s}
    open_ones = [(s.split("*"), k) for k, s in enumerate(sentences.values(), 1) if "*" in s]
    table = F.create_map(*[F.lit(v) for pair in whole_ones.items() for v in pair]) if whole_ones else F.create_map().cast("map<string,int>")

    def number(sentence: Column) -> Column:
        found = [table[sentence]]
        for (start, *middle, end), k in open_ones:
            fits = F.startswith(sentence, F.lit(start)) & F.endswith(sentence, F.lit(end))
            if middle:
                words = ".*".join(re.escape(part) for part in (start, *middle, end))
                fits = fits & F.rlike(sentence, F.lit(f"^{words}$"))
            else:
                fits = fits & (F.length(sentence) > len(start) + len(end))
            found.append(F.when(fits, F.lit(k)))
        return F.coalesce(*found)

    def of_sentence(sentence: Column) -> Column:
        whole = F.array_compact(F.array(number(normalised(sentence))))
        lines = F.array_compact(F.transform(F.split(sentence, "\n"), lambda line: number(normalised(line))))
        both = F.concat(F.array_except(whole, lines), lines)
        return F.when(F.contains(sentence, F.lit("\n")), both).otherwise(whole)

    return F.flatten(F.transform(F.split(F.lower(text), PARAGRAPHS), of_sentence))


def times(ids: Column, wanted: list[int], together: bool) -> Column:
    """How often the wanted numbers are met in order, one time after the other, or together."""
    size, places = len(wanted), F.array(*[F.lit(k) for k in wanted])

    def step(n: Column, k: Column) -> Column:
        back = n - n % size + (k == wanted[0]).cast("int") if together else n
        return F.when(k == F.element_at(places, n % size + 1), n + 1).otherwise(back)

    return F.floor(F.aggregate(ids, F.lit(0), step) / size)


def licenses(ids: Column, sentences: dict[str, str], rules: list[tuple[str, Sequence[str]]]) -> Column:
    """Distinct licences of the matched rules, without those that longer matched rules contain.

    A rule counts as often as it is met more often than within longer rules, so a shorter
    licence beside a longer one that contains it is found too.
    """
    numbers = {name: k for k, name in enumerate(sentences, 1)}
    nested = {k: [j for j, (_, other) in enumerate(rules) if contained(names, other)] for k, (_, names) in enumerate(rules)}

    def times_of(k: int) -> Column:
        names = rules[k][1]
        return times(ids, [numbers[name] for name in names], isinstance(names, tuple))

    found = []
    for k, (licence, _) in enumerate(rules):
        matched = times_of(k)
        # Of a licence's own longer rules nothing need be taken off.
        if any(rules[j][0] != licence for j in nested[k]):
            matched = matched - own_times(nested[k], nested, times_of)
        found.append(F.when(matched > 0, F.lit(licence)))
    return F.when(F.size(ids) > 0, F.array_distinct(F.array_compact(F.array(*found)))).otherwise(F.array().cast("array<string>"))


def own_times(chosen: list[int], nested: dict[int, list[int]], times_of) -> Column:
    """Times of the chosen rules, each without those within longer chosen ones."""
    total = F.lit(0)
    for j in chosen:
        inner = [i for i in nested[j] if i in chosen]
        total = total + times_of(j) - (own_times(inner, nested, times_of) if inner else F.lit(0))
    return total


def spdx_licenses(text: Column, rules: list[tuple[str, Sequence[str]]]) -> Column:
    """Licences that lines with an SPDX tag name, in the spelling of the rules, or as they stand."""
    spelling = {licence.lower(): licence for licence, _ in rules} | {old.lower(): new for old, new in SPDX_OLD.items()}
    spelled = F.create_map(*[F.lit(v) for pair in spelling.items() for v in pair])
    lines = F.regexp_extract_all(text, F.lit(SPDX_LINE), F.lit(1))

    def names(line: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(line, r"[()]", " "), r"(?i)[ \t]+with[ \t]+[^ \t]+", " ")
        return F.filter(F.split(plain, r"(?i)[ \t]+(?:and|or)[ \t]+|[ \t]+"), lambda name: name != "")

    found = F.transform(F.flatten(F.transform(lines, names)), lambda name: F.coalesce(spelled[F.lower(name)], name))
    return F.when(F.contains(F.lower(text), F.lit(SPDX_TAG)), found).otherwise(F.array().cast("array<string>"))


def listed(ids: Column) -> Column:
    """The numbers as text, each between commas, or one comma."""
    return F.concat(F.lit(","), F.array_join(F.transform(ids, lambda n: F.concat(n.cast("string"), F.lit(","))), ""))


def scan(
    docs: DataFrame,
    sentences: dict[str, str] = DEFAULT_SENTENCES,
    rules: list[tuple[str, Sequence[str]]] = DEFAULT_RULES,
) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses) of every row.

    n_sentences counts the known sentences of both readings, sentence_ids has their numbers
    in order between commas, licenses the names joined by commas, those of lines with an
    SPDX tag among them, which are no sentences. A null or empty text has none.
    `sentences` names normalised sentences; `rules` are a licence and its sentences in order.
    Whole texts are read; rows that repeat or lack a doc_id are scanned like others.
    Columns other than doc_id and text are not read.
    """
    unknown = sorted({name for _, names in rules for name in names} - set(sentences))
    if unknown or not all(names for _, names in rules):
        raise ValueError(f"rules without sentences, or with unknown ones: {unknown}")
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), sentence_ids(text, sentences).alias("ids"), spdx_licenses(text, rules).alias("named")
    )
    return read.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        listed(F.col("ids")).alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_union(licenses(F.col("ids"), sentences, rules), F.col("named"))), ",").alias("licenses"),
    )
