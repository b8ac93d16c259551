"""Licence scans by sentence rules (native).

A text is cut into sentences three times: at line ends and sentence ends, and, with
hard-wrapped lines joined, at sentence ends alone, and at sentence ends and blank
lines (here parts of sentences are known, too; the SQL lacks this cut).  Each sentence is normalised
(lower case, every run of other than a-z and 0-9 one space) and mapped to the
identifier of a known licence sentence, all others are passed over.  What is
left is a short sequence of identifiers, which ordered rules are matched with: a
rule holds if its identifiers come in its order, others between them or not.

All work is inside the row: no shuffle, no join, and no state beyond two literal
tables of fixed size.  Null or empty texts have no sentences and no licence; a
repeated row is a row of its own; an empty table gives no rows; columns other
than ``doc_id`` and ``text`` are ignored.  Whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Known licence sentences, already normalised, by identifier.  (Fixed values: public licence texts.)
SENTENCES = {
    "apache-licensed": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "asis-law": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "see-license": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-ref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "the mit license", "the mit license mit", "mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-asis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-asis": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-ref": ["licensed under the bsd license", "released under the bsd license", "use of this source code is governed by a bsd style license that can be found in the license file"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-details": ["see the gnu general public license for more details"],
    "gpl3-ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "licensed under the gnu gpl version 3"],
    "gpl2-ref": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "lgpl3-ref": ["licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"],
    "agpl3-ref": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"],
    "mpl-form": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "mpl-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "mpl-ref": ["licensed under the mozilla public license version 2 0"],
    "cc-by-ref": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa-ref": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc-ref": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc0-ref": ["licensed under cc0 1 0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "all-rights": ["all rights reserved"],
}

#: Ordered rules: the licence, its sentences in order, and the licences whose presence voids it.
RULES = [
    ("AGPL-3.0", ["agpl3-ref"], []),
    ("Apache-2.0", ["apache-licensed"], []),
    ("Apache-2.0-header", ["apache-licensed", "apache-comply", "apache-copy", "asis-law", "see-license"], []),
    ("BSD", ["bsd-ref"], ["BSD-2-Clause", "BSD-3-Clause"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"], ["BSD-3-Clause"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"], []),
    ("CC-BY-4.0", ["cc-by-ref"], []),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"], []),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"], []),
    ("CC0-1.0", ["cc0-ref"], []),
    ("GPL-2.0", ["gpl2-ref"], []),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-details"], []),
    ("GPL-3.0", ["gpl3-ref"], []),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"], []),
    ("ISC", ["isc-grant", "isc-asis"], []),
    ("LGPL-3.0", ["lgpl3-ref"], []),
    ("MIT", ["mit-ref"], []),
    ("MIT-text", ["mit-grant", "mit-notice", "mit-asis"], []),
    ("MPL-2.0", ["mpl-ref"], []),
    ("MPL-2.0-notice", ["mpl-form", "mpl-copy"], []),
    ("Unlicense", ["unlicense"], []),
    ("all-rights-reserved", ["all-rights"], []),
]

#: Where a sentence ends, and where a line does too.
SENTENCE_END = r"[.;!?:]+[ \t\r\n]+"
LINE_END = SENTENCE_END + r"|\n"
#: Where a sentence of hard-wrapped lines ends: at a line without a letter or digit (``#`` or ``*`` of a comment) as well.
PARAGRAPH_END = SENTENCE_END + r"|\n[^\p{L}\p{N}\n]*\n"

_MAY = "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
_EITHER = "either version {} of the license or at your option any later version"
_COPY = "you may obtain a copy of the license at"
_URLS = ["http www apache org licenses license 2 0", "https www apache org licenses license 2 0"]
#: Parts of known sentences that the standard notices show, as PARAGRAPH_END cuts them.  (The SQL has them not.)
PARTS = {
    "gpl-program": ["this program is free software"],
    "gpl-may": [_MAY],
    "gpl-either": [_EITHER.format(3)],
    "gpl-may-either": [f"{_MAY} {_EITHER.format(3)}"],
    "gpl2-either": [_EITHER.format(2)],
    "gpl2-may-either": [f"{_MAY} {_EITHER.format(2)}"],
    "gpl-useful": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "gpl-implied": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "mpl-subject": ["this source code form is subject to the terms of the mozilla public license v"],
    "apache-obtain": [_COPY],
    "apache-url": _URLS,
    "apache-copy-s": [f"{_COPY} {_URLS[1]}"],
    "apache-copy-law": [f"{_COPY} {u} {SENTENCES['asis-law'][0]}" for u in _URLS],
}
_HOPE = ["gpl-useful", "gpl-implied", "gpl-details"]
#: Other sequences with which a rule holds.
PART_RULES = {
    "Apache-2.0-header": [
        ["apache-licensed", "apache-comply", *copy, "see-license"]
        for copy in (["apache-obtain", "apache-url", "asis-law"], ["apache-copy-s", "asis-law"], ["apache-copy-law"])
    ],
    "GPL-2.0-or-later": [["gpl-program", "gpl-may", "gpl2-either", *_HOPE], ["gpl-program", "gpl2-may-either", *_HOPE]],
    "GPL-3.0-or-later": [["gpl-program", "gpl-may", "gpl-either", *_HOPE], ["gpl-program", "gpl-may-either", *_HOPE]],
    "MPL-2.0-notice": [["mpl-subject", "mpl-copy"]],
}


def _known(sentences: dict[str, list[str]]) -> Column:
    pairs = [x for key, texts in sentences.items() for text in texts for x in (F.lit(text), F.lit(key))]
    return F.create_map(*pairs)


def sentence_ids(text: Column, ends: str, sentences: dict[str, list[str]] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    norm = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    ids = F.transform(F.split(F.coalesce(text, F.lit("")), ends, -1), lambda s: F.try_element_at(_known(sentences), norm(s)))
    return F.filter(ids, lambda i: i.isNotNull())


def match_rules(fine: Column, joined: Column, parts: Column) -> Column:
    """Licences, in the rules' order, whose sentences come in order in any sequence."""

    def holds(ids: list[str], seq: Column) -> Column:
        return F.concat(F.lit(","), F.array_join(seq, ",,"), F.lit(",")).rlike("(?s)" + ".*".join(f",{i}," for i in ids))

    found = {name: holds(ids, fine) | holds(ids, joined) | holds(ids, parts) for name, ids, _ in RULES}
    for name, others in PART_RULES.items():
        for ids in others:
            found[name] = found[name] | holds(ids, parts)
    names = []
    for name, _, void in RULES:
        ok = found[name]
        for other in void:
            ok = ok & ~found[other]
        names.append(F.when(ok, F.lit(name)))
    some = (F.size(fine) > 0) | (F.size(joined) > 0) | (F.size(parts) > 0)
    return F.when(some, F.filter(F.array(*names), lambda n: n.isNotNull())).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, sentence_ids, licenses`` (arrays) of every document."""
    lines = sentence_ids(F.col("text"), LINE_END)
    wrapped = sentence_ids(F.col("text"), SENTENCE_END)
    parts = sentence_ids(F.col("text"), PARAGRAPH_END, SENTENCES | PARTS)
    return docs.select("doc_id", lines.alias("fine"), wrapped.alias("joined"), parts.alias("parts")).select(
        "doc_id", F.col("fine").alias("sentence_ids"), match_rules(F.col("fine"), F.col("joined"), F.col("parts")).alias("licenses")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"),
    )


def _oracle() -> str:
    known = ", ".join(f"('{t}', '{k}')" for k, ts in SENTENCES.items() for t in ts)

    def holds(ids: list[str]) -> str:
        like = "%".join(f",{i}," for i in ids)
        return f"(fine LIKE '%{like}%' OR joined LIKE '%{like}%')"

    found = {name: holds(ids) for name, ids, _ in RULES}
    cases = ", ".join(
        f"CASE WHEN {' AND '.join([found[name], *(f'NOT {found[v]}' for v in void)])} THEN '{name}' END" for name, _, void in RULES
    )
    norm = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
    cut = lambda ends: f"list_transform(string_split_regex(coalesce(text, ''), '{ends}'), lambda s: {norm})"
    # list_position in the known sentences gives null for all others
    ids = lambda ends: f"list_filter(list_transform({cut(ends)}, lambda n: keys[list_position(sentences, n)]), lambda k: k IS NOT NULL)"
    return f"""
WITH known AS (SELECT list(s) AS sentences, list(k) AS keys FROM (VALUES {known}) t(s, k)),
seqs AS (SELECT row_number() OVER () AS r, doc_id, {ids(LINE_END)} AS f, {ids(SENTENCE_END)} AS j FROM documents, known),
flat AS (SELECT doc_id, f, ',' || array_to_string(f, ',,') || ',' AS fine, ',' || array_to_string(j, ',,') || ',' AS joined FROM seqs)
SELECT doc_id, len(f)::BIGINT AS n_sentences, array_to_string(f, ',') AS sentence_ids,
  array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',') AS licenses
FROM flat
"""


ORACLE_SQL = _oracle()
