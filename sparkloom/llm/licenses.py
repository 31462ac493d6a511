"""Licence recognition from sentences. DataFrame functions only.

Texts are cut at line breaks and sentence ends, normalised, and known licence sentences are found among the
pieces, also where a line break, a comment mark or one of ! ? ; : is inside a sentence. What remains of a
document is the sequence of sentence identifiers; ordered rules are matched against it, longest first,
left to right, each sentence used once. Sentences of a rule that are too far apart are not one licence.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import documents

#: What n_sentences counts ends at a line break, or at a full stop with white space after it.
SENTENCE_END = r"[\n\r]+|\.[^\p{L}\p{N}\s]*\s"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: No known sentence goes over a line without letters and digits, or a full stop with white space after it.
#: The repeated group is possessive: Java matches it in a loop, other groups by recursion, whose stack long runs exhaust.
PARAGRAPH_END = r"(?>\R)(?:[^\p{L}\p{N}\n\r]*(?>\R))++|\.[^\p{L}\p{N}\s]*\s"
#: A known sentence may begin and end here, or go on.
PIECE_END = r"[\n\r]+|[!?;:][^\p{L}\p{N}\s]*\s"
#: Sentences with a holder's name in them: what stands before it, after it, and the same without a holder. Fixed values.
HOLDERS = [
    ("neither the names? of ", r"nor the names of (?:its|their|any) contributors", "neither the name of ", "the copyright holder nor the names of its contributors"),
    ("this software is provided by ", "as is", "this software is provided by ", "the copyright holders and contributors as is"),
]

#: Known sentences as normalised (lower case, other characters than letters and digits one space): identifier. Fixed values.
SENTENCES = {
    "released under the mit license": "mit-named",
    "licensed under the mit license": "mit-named",
    "this project is licensed under the mit license": "mit-named",
    "spdx license identifier mit": "mit-named",
    "licensed under the apache license version 2 0": "apache-named",
    "licensed under the apache license version 2 0 the license": "apache-named",
    "spdx license identifier apache 2 0": "apache-named",
    "you may not use this file except in compliance with the license": "apache-use",
    "you may obtain a copy of the license at": "apache-copy",
    "this work is licensed under the gnu general public license version 3": "gpl3-only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3": "gpl3-only",
    "spdx license identifier gpl 3 0 only": "gpl3-only",
    "this work is licensed under the gnu general public license version 2": "gpl2-only",
    "spdx license identifier gpl 2 0 only": "gpl2-only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license": "gpl3-only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "spdx license identifier gpl 3 0 or later": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license": "gpl2-only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "spdx license identifier gpl 2 0 or later": "gpl2-later",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-copy",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind": "mit-warranty",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation": "bsd-binary",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd-names",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this software is provided by the copyright holders and contributors as is": "bsd-warranty",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "all rights reserved": "reserved",
}
#: Ordered rules: identifiers in sequence, licence. An earlier rule wins where several start. Fixed values.
RULES = [
    (["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty"], "BSD-3-Clause"),
    (["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"], "BSD-2-Clause"),
    (["mit-grant", "mit-notice", "mit-warranty"], "MIT"),
    (["apache-named", "apache-use", "apache-copy"], "Apache-2.0"),
    (["apache-named", "apache-use"], "Apache-2.0"),
    (["isc-grant", "isc-warranty"], "ISC"),
    (["unlicense-domain", "unlicense-grant"], "Unlicense"),
    (["zlib-warranty", "zlib-grant"], "Zlib"),
    (["apache-named"], "Apache-2.0"),
    (["mit-named"], "MIT"),
    (["unlicense-domain"], "Unlicense"),
    (["cc-by-4.0"], "CC-BY-4.0"),
    (["reserved"], "proprietary-notice"),
]

#: GNU licences: short name, name in full, versions. Fixed values.
GNU = {
    "GPL": ("gnu general public license", ["1", "2", "3"]),
    "LGPL": ("gnu lesser general public license", ["2 1", "3"]),
    "AGPL": ("gnu affero general public license", ["3"]),
}
#: Licences that a sentence names: identifier, names. Fixed values.
NAMED = {
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "0BSD": ["zero clause bsd license", "bsd zero clause license"],
    "ISC": ["isc license"],
    "Zlib": ["zlib license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "MPL-1.1": ["mozilla public license version 1 1", "mozilla public license 1 1"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0"],
    "CDDL-1.0": ["common development and distribution license version 1 0", "common development and distribution license 1 0"],
    "EUPL-1.2": ["european union public licence version 1 2", "european union public licence 1 2"],
    "Artistic-2.0": ["artistic license version 2 0", "artistic license 2 0"],
    "MS-PL": ["microsoft public license"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license 1 1"],
    "WTFPL": ["do what the fuck you want to public license"],
    "PostgreSQL": ["postgresql license"],
    "NCSA": ["university of illinois ncsa open source license"],
    "ODbL-1.0": ["open database license version 1 0", "open database license"],
    "Unlicense": ["unlicense"],
    "Apache-2.0": ["apache license 2 0", "apache 2 0 license"],
}
#: Sentences of licences that bring their own, besides those above. Fixed values.
OTHERS = {
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2.0",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-1.0",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl",
}

#: Creative Commons: licence, spellings of its name; version, words after the number. Country versions are not known.
CC_NAMES = {
    "by": ["attribution"],
    "by sa": ["attribution sharealike", "attribution share alike"],
    "by nc": ["attribution noncommercial", "attribution non commercial"],
    "by nd": ["attribution noderivatives", "attribution no derivatives", "attribution noderivs", "attribution no derivs"],
    "by nc sa": ["attribution noncommercial sharealike", "attribution non commercial share alike"],
    "by nc nd": ["attribution noncommercial noderivatives", "attribution non commercial no derivatives", "attribution noncommercial noderivs", "attribution non commercial no derivs"],
}
CC_VERSIONS = {"4 0": "international", "3 0": "unported", "2 5": "generic", "2 0": "generic", "1 0": "generic"}
#: What may stand before the name of a licence; it counts as `licensed under`. A space stands for one or a line break.
OPENING = "(?:this (?:work|project|software|repo|repository|program|library|file|code|document) is )?(?:licensed|released|distributed) under (?:the terms of )?(?:(?:an|a|the) )?"


def _families() -> None:
    """Adds the families to SENTENCES and RULES: Creative Commons, GNU, and licences by name and SPDX identifier."""
    plain = lambda x: x.lower().replace("-", " ").replace(".", " ")
    for short, version in itertools.product(CC_NAMES, CC_VERSIONS):
        word, licence = CC_VERSIONS[version], f"CC-{short.upper().replace(' ', '-')}-{version.replace(' ', '.')}"
        forms = [f"cc {short} {version}{end}" for end in ("", " license", f" {word} license")]
        forms += [f"creative commons {name} {version}{end}" for name in CC_NAMES[short] for end in (" license", f" {word} license", f" {word}", f" {word} public license", "")]
        SENTENCES.update({f"licensed under {form}": licence.lower() for form in forms})
        SENTENCES[f"spdx license identifier {plain(licence)}"] = licence.lower()
        if licence != "CC-BY-4.0":
            RULES.append(([licence.lower()], licence))
    forms = ["cc0", "cc0 1 0", "cc0 1 0 universal", "cc0 1 0 universal license", "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal license"]
    SENTENCES.update({f"licensed under {form}": "cc0" for form in forms})
    SENTENCES["spdx license identifier cc0 1 0"] = "cc0"
    RULES.append((["cc0"], "CC0-1.0"))
    program = ("this program", "this library", "this file", "this software")
    may = "you can redistribute it and or modify it under the terms of the"
    for short, (name, versions) in GNU.items():
        for version in versions:
            number = version.replace(" ", ".") + ("" if " " in version else ".0")
            for later in (False, True):
                key = f"{short.lower()}{version.replace(' ', '.')}-{'later' if later else 'only'}"
                ends = [" or at your option any later version", " or any later version", " or later"] if later else [""]
                forms = [f"{name} {v} {version}{end}" for v in ("version", "v") for end in ends] + [f"{name} v{version}{end}" for end in ends]
                long = [f"{name} as published by the free software foundation {either}version {version} of the license{ends[0]}" for either in (("either ",) if later else ("",))]
                if not later:
                    long.append(f"{name} version {version} as published by the free software foundation")
                SENTENCES.update({f"{x} is free software {may} {form}": key for x in program for form in forms + long})
                SENTENCES.update({f"licensed under {form}": key for form in forms})
                SENTENCES[f"spdx license identifier {short.lower()} {plain(number)} {'or later' if later else 'only'}"] = key
                RULES.append(([key], f"{short}-{number}-{'or-later' if later else 'only'}"))
    for licence, found in NAMED.items():
        key = {"Apache-2.0": "apache-named", "Unlicense": "unlicense-domain"}.get(licence, licence.lower())
        SENTENCES.update({f"licensed under {form}": key for form in found})
        SENTENCES[f"spdx license identifier {plain(licence)}"] = key
        if key == licence.lower():
            RULES.append(([key], licence))
    SENTENCES.update({f"licensed under mit license{end}": "mit-named" for end in ("", " see license", " see license file")})
    SENTENCES.update(OTHERS)
    for s in list(SENTENCES):
        SENTENCES[re.sub(f"^{OPENING}", "licensed under ", s)] = SENTENCES.pop(s)


_families()
#: Unknown characters between the sentences of a rule, at most, unless scan_licenses() is told another number.
APART = 4000
#: Characters of a holder's name, at most, unless it is told another number; beyond, two sentences are apart by chance.
HOLDER = 1000


def _plain(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), NOT_WORD, " "))


def sentences(text: Column) -> Column:
    """Normalised pieces between line breaks and full stops in order, empty ones left out; null for a null text."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), _plain), lambda s: s != "")


def _lines(pattern: str) -> str:
    """The pattern with a line break wherever it has a space."""
    return pattern.replace(" ", r"[ \n]")


def without_holders(text: Column, holder: int | None) -> Column:
    """Normalised pieces with holders of at most `holder` characters as the known sentences have them. The text is cut
    where the words before a holder stand, so each part is read once, however long holders are and however many."""
    length = "+" if holder is None else f"{{1,{holder}}}"
    for before, after, opening, same in HOLDERS:
        pattern = rf"\A[\p{{L}}\p{{N}} \n]{length}?[ \n]+{_lines(after)}"
        text = F.array_join(F.transform(F.split(text, _lines(before)), _after_first(pattern, same)), opening)
    return text


def _after_first(pattern: str, same: str) -> Callable[[Column, Column], Column]:
    return lambda part, i: F.when(i == 0, part).otherwise(F.regexp_replace(part, pattern, same))


def pieces(text: Column, holder: int | None) -> Column:
    """The text as normalised pieces, a line break between two of a paragraph, two between paragraphs."""
    cut = lambda t: F.array_join(F.filter(F.transform(F.split(t, PIECE_END), _plain), lambda s: s != ""), "\n")
    out = F.array_join(F.transform(F.split(text, PARAGRAPH_END), cut), "\n\n")
    return F.regexp_replace(without_holders(out, holder), rf"(?<![^\n]){_lines(OPENING)}", "licensed under ")


def _pattern(known: list[list[str]]) -> str:
    """A regular expression of word sequences with common beginnings shared, the longer first."""
    by: dict[str, list[list[str]]] = {}
    for words in known:
        if words:
            by.setdefault(words[0], []).append(words[1:])
    out = []
    for word, rests in by.items():
        while len(rests) == 1 and rests[0] or len(rests) > 1 and all(r and r[0] == rests[0][0] for r in rests):
            word, rests = word + r"[ \n]" + rests[0][0], [r[1:] for r in rests]
        more = [r for r in rests if r]
        out.append(word + (rf"(?:[ \n]{_pattern(more)})" + ("" if len(more) == len(rests) else "?") if more else ""))
    return f"(?:{'|'.join(out)})"


#: A known sentence from one end of a piece to another, perhaps with the number of a list before it.
KNOWN = rf"(?<![^\n])(?:\d{{1,2}} )?({_pattern([s.split(' ') for s in SENTENCES])})(?![^\n])"
#: Rules over identifiers in angle brackets, an earlier one first.
MATCHED = "|".join("".join(f"<{re.escape(i)}>" for i in ids) for ids, _ in RULES).replace("\\-", "-")
LICENCES = {"".join(f"<{i}>" for i in ids): licence for ids, licence in RULES}


def scan_licenses(df: DataFrame, text: str = "text", apart: int | None = APART, holder: int | None = HOLDER) -> DataFrame:
    """df with n_sentences, `sentence_ids` (known sentences in order, in angle brackets), `licenses` (one per matched
    rule, in order) and `unmatched` (known sentences that no rule used).

    n_sentences counts pieces between line breaks and full stops, so a wrapped sentence as often as it has lines.
    Unknown sentences between known ones do not break a rule, unless there are more than `apart` characters of them; a holder's
    name in a known sentence may have `holder` characters. None: however many there are.
    Null and empty texts have no sentences. Columns with the names of results are replaced, all others stay. Every row
    stands alone: no shuffle.
    """
    table = lambda found: F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in found.items())), F.lit("\n"), F.lit("\t"))
    known, names = table(SENTENCES), table(LICENCES)
    found = df.withColumn("n_sentences", F.coalesce(F.size(sentences(F.col(text))), F.lit(0)))
    # each known sentence between marks, which normalised text has not; the first part is what stands before the first
    marked = F.split(F.regexp_replace(pieces(F.coalesce(F.col(text), F.lit("")), holder), KNOWN, "\x01$1\x02"), "\x01")

    def identifier(part):
        own = F.try_element_at(known, F.translate(F.substring_index(part, "\x02", 1), "\n", " "))
        far = F.lit(False) if apart is None else F.length(F.substring_index(part, "\x02", -1)) > apart
        return F.concat(F.lit("<"), own, F.when(far, ">|").otherwise(">"))

    found = found.withColumn("sentence_ids", F.array_join(F.transform(F.slice(marked, 2, 1 << 30), identifier), ""))
    found = found.withColumn("licenses", F.transform(F.regexp_extract_all("sentence_ids", F.lit(MATCHED), F.lit(0)), lambda h: F.try_element_at(names, h)))
    found = found.withColumn("unmatched", F.regexp_count(F.regexp_replace("sentence_ids", MATCHED, ""), F.lit("<")))
    return found.withColumn("sentence_ids", F.replace("sentence_ids", F.lit("|"), F.lit("")))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", "sentence_ids", F.array_join("licenses", ",").alias("licenses"), "unmatched")


def _sql() -> str:
    quoted = lambda x: "'" + x + "'"
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in SENTENCES.items())
    names = "map {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in LICENCES.items()) + "}"
    return rf"""
with k(s, id) as (values {known}),
s as (
  select doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '{SENTENCE_END}'),
    lambda x: trim(regexp_replace(lower(x), '{NOT_WORD}', ' ', 'g'))), lambda x: x <> '') as s from documents),
u as (select doc_id, s[i] as x, i from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from s)),
h as (select doc_id, string_agg('<' || id || '>', '' order by i) as ids from u join k on regexp_replace(x, '^{OPENING}', 'licensed under ') = k.s group by doc_id),
i as (select s.doc_id, len(s.s)::int as n_sentences, coalesce(ids, '') as sentence_ids from s left join h on h.doc_id = s.doc_id)
select doc_id, n_sentences, sentence_ids,
  coalesce(array_to_string(list_transform(regexp_extract_all(sentence_ids, '{MATCHED}'), lambda x: ({names})[x]), ','), '') as licenses,
  len(regexp_extract_all(regexp_replace(sentence_ids, '{MATCHED}', '', 'g'), '<'))::int as unmatched
from i"""


OP2_SQL = _sql()
