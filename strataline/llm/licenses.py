"""Licence scan: known sentences become identifiers, and ordered rules match runs of identifiers. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of published licences and licence notices (fixed values), as they stand in the texts.
SENTENCES: dict[str, str] = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-grant-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-named": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-project": "This project is licensed under the MIT License.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zero-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-grant-source": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-grant-1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-licensed": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-may": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-named": "Licensed under the Apache License, Version 2.0.",
    "apache-released": "Released under the Apache License, Version 2.0.",
    "gpl2-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-free": "This program is free software;",
    "gpl-can": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-later": "either version 2 of the License, or (at your option) any later version.",
    "gpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-without": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "gpl3-named": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-named": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl3-named": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl3-named": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-subject-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl2-subject-2": "2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl2-copy-s": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-named": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-named": "Licensed under CC BY 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-named": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-named": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-named": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-named": "Licensed under CC BY-ND 4.0.",
    "reserved": "All rights reserved.",
}

#: Rules in the order in which they are tried: a licence and the run of sentence identifiers that states it. A run that
#: matches is used up, so that fuller statements go before the shorter ones that they contain.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant-notice", "mit-warranty", "mit-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-grant-source", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-grant-1", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd-grant-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd-grant-1", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-licensed", "apache-may", "apache-obtain", "apache-see"]),
    ("Apache-2.0", ["apache-licensed", "apache-may"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-can", "gpl2-later", "gpl-hope", "gpl-without", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-can", "gpl2-later"]),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-hope", "gpl-without", "gpl-details"]),
    ("AGPL-3.0-or-later", ["agpl3-grant", "gpl-hope", "gpl-without", "agpl-details"]),
    ("MPL-2.0", ["mpl2-subject-1", "mpl2-subject-2", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-subject-1", "mpl2-subject-2", "mpl2-copy-s"]),
    ("Unlicense", ["unlicense-domain", "unlicense-anyone"]),
    ("MIT", ["mit-named"]), ("MIT", ["mit-licensed"]), ("MIT", ["mit-project"]), ("MIT", ["mit-grant"]),
    ("ISC", ["isc-grant"]), ("0BSD", ["zero-grant"]),
    ("Apache-2.0", ["apache-named"]), ("Apache-2.0", ["apache-released"]),
    ("GPL-2.0-or-later", ["gpl2-grant"]), ("GPL-3.0-or-later", ["gpl3-grant"]), ("AGPL-3.0-or-later", ["agpl3-grant"]),
    ("GPL-3.0-only", ["gpl3-named"]), ("GPL-2.0-only", ["gpl2-named"]), ("LGPL-3.0-only", ["lgpl3-named"]), ("AGPL-3.0-only", ["agpl3-named"]),
    ("MPL-2.0", ["mpl2-subject"]), ("Unlicense", ["unlicense-domain"]), ("CC0-1.0", ["cc0-named"]),
    ("CC-BY-4.0", ["cc-by-named"]), ("CC-BY-4.0", ["cc-by-long"]), ("CC-BY-SA-4.0", ["cc-by-sa-named"]), ("CC-BY-SA-4.0", ["cc-by-sa-long"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-named"]), ("CC-BY-NC-4.0", ["cc-by-nc-long"]), ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-named"]), ("CC-BY-ND-4.0", ["cc-by-nd-named"]),
    ("all rights reserved", ["reserved"]),
]

#: A sentence ends at these marks when white space follows, and at a blank line; ``CUT`` marks the places.
END, CUT = r"([.!?;])[\x09-\x0D\x20]+|\n[\x09-\x0D\x20]*\n", "\x01"
#: For texts in comment blocks: a line without a letter or digit is as good as a blank one, and a copyright line is a sentence of its own.
BLOCK_END = r"([.!?;])[\x09-\x0D\x20]+|\n[\x09-\x0D\x20-/:-@\x5B-`{-~]*\n"
COPYRIGHT = r"(?im)^([\x09\x20-/:-@\x5B-`{-~]*(?:copyright[\x09\x20:]*(?:\(c\)|\u00A9|[0-9]{4}|by\b)|\u00A9|\(c\)[\x09\x20]*(?:copyright|[0-9]{4}))[^\n]*)$"
#: The clause on names holds whatever name stands there; a name with a full stop leaves the clause's end as a sentence.
NAMED, ANYONE = "^(?:neither the name of .* )?nor the names of its contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used"
#: Rules after the others, for a notice whose grant is worded or cut in another way. Warranty and liability alone also stand in other licences.
PARTIAL: list[tuple[str, list[str]]] = [("MIT", ["mit-notice", "mit-warranty", "mit-liability"])]


def normal(sentence: str) -> str:
    """The form in which sentences are compared: a-z and 0-9, all else one space."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


KEYS = {normal(s): name for name, s in SENTENCES.items()}


def _recognised(sentences: Column) -> Column:
    """The identifiers of the known ones among sentences, in order, as one string <a><b>."""
    keys = F.transform(sentences, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    keys = F.transform(keys, lambda k: F.when(F.contains(k, F.lit("nor the names of its contributors")), F.regexp_replace(k, NAMED, ANYONE)).otherwise(k))
    known = F.filter(keys, lambda k: k.isin(*KEYS))
    name = F.create_map(*[F.lit(x) for pair in KEYS.items() for x in pair])
    return F.array_join(F.transform(known, lambda k: F.concat(F.lit("<"), F.element_at(name, k), F.lit(">"))), "")


def license_scan(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` plus ``licenses`` (names in the order of the rules, joined by commas, empty if none),
    ``sentence_ids`` and ``line_sentence_ids``; columns of those names are replaced.

    A text is cut into sentences twice: with line feeds as mere white space, so
    that wrapped notices are whole, and with every line for itself, so that a
    notice below a title is found. Sentences are reduced to letters and digits
    and looked up among the known ones; the runs of identifiers are then
    matched by the rules in order. A third cut, for ``licenses`` alone, reads
    comment blocks: lines of comment marks end sentences, and copyright lines
    stand for themselves. Any cut may state a licence.

    Whole texts are read. A null or empty text has no licence. Rows that repeat
    a doc_id (or have none) are scanned each for itself, in place: nothing is
    shuffled. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = F.regexp_replace(text, END, "$1" + CUT)
    kept = [c for c in docs.columns if c not in ("licenses", "sentence_ids", "line_sentence_ids")]
    out = docs.select(*kept, _recognised(F.split(cut, CUT)).alias("sentence_ids"), _recognised(F.split(F.regexp_replace(text, END + r"|\n", "$1" + CUT), CUT)).alias("line_sentence_ids"),
                      _recognised(F.split(F.regexp_replace(F.regexp_replace(text, COPYRIGHT, "$1" + CUT), BLOCK_END, "$1" + CUT), CUT)).alias("_block_ids"))

    def stated(ids: Column) -> Column:
        """Names of the rules that match, each on what those before have left."""
        rest, names = ids, []
        for name, run in RULES + PARTIAL:
            pattern = "".join(f"<{i}>" for i in run)
            names.append(F.when(F.contains(rest, F.lit(pattern)), F.lit(name)))
            rest = F.replace(rest, F.lit(pattern), F.lit(""))
        return F.array_compact(F.array(*names))

    def found(ids: Column) -> Column:
        return F.when(ids == "", F.array().cast("array<string>")).otherwise(stated(ids))

    union = F.array_union(F.array_union(found(F.col("sentence_ids")), found(F.col("line_sentence_ids"))), found(F.col("_block_ids")))
    order = list(dict.fromkeys(name for name, _ in RULES))
    return out.withColumn("licenses", F.array_join(F.array_intersect(F.array(*map(F.lit, order)), union), ",")).drop("_block_ids")


def oracle() -> str:
    """The scan as DuckDB SQL, without what comment blocks, other names in the BSD clause and PARTIAL add."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    known = ", ".join(f"({quoted(k)}, {quoted(n)})" for k, n in KEYS.items())
    end = END
    steps, rest = [], "ids"
    for name, run in RULES:
        pattern = quoted("".join(f"<{i}>" for i in run))
        steps.append(f"CASE WHEN contains({rest}, {pattern}) THEN {quoted(name)} END")
        rest = f"replace({rest}, {pattern}, '')"
    order = ", ".join(quoted(n) for n in dict.fromkeys(name for name, _ in RULES))
    return rf"""
WITH k(key, name) AS (VALUES {known}),
c AS (SELECT doc_id, 1 AS cut, string_split(regexp_replace(coalesce(text, ''), '{end}', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents
    UNION ALL SELECT doc_id, 2, string_split(replace(regexp_replace(coalesce(text, ''), '{end}', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)) FROM documents),
s AS (SELECT doc_id, cut, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM c),
i AS (SELECT doc_id, cut, string_agg('<' || name || '>', '' ORDER BY pos) AS ids FROM s JOIN k ON k.key = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) GROUP BY ALL),
f AS (SELECT doc_id, unnest([{", ".join(steps)}]) AS name FROM i),
n AS (SELECT doc_id, array_to_string(list_filter([{order}], lambda x: list_contains(list(name), x)), ',') AS licenses FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.ids, '') AS sentence_ids, coalesce(b.ids, '') AS line_sentence_ids, coalesce(n.licenses, '') AS licenses FROM documents d
LEFT JOIN i a ON a.doc_id = d.doc_id AND a.cut = 1 LEFT JOIN i b ON b.doc_id = d.doc_id AND b.cut = 2 LEFT JOIN n ON n.doc_id = d.doc_id
"""
