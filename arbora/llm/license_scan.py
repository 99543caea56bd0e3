"""License scans by diagonal voting.

Every rolling word k-gram hash of a text is joined with the template positions of the same k-gram. Hits vote for a
diagonal, which is the word position less the template position. Hits in a row on one diagonal are a segment. Segments
of neighbouring diagonals are merged into a span by aligning them: they must stand in the same order in text and
template, and so many words may lie between them that an inserted sentence does not break a notice. A span is verified
by the share of the template's words that it covers, which must include the words that tell the notice from others.

Phrases have k-grams of their own, and count where the whole phrase stands on one diagonal.

Defined cases: a null or empty text has no words, no labels and score 0; rows that share an id are scanned apart;
an empty table gives an empty result; a text may hold a notice any number of times; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import gram_hashes, materialize, word_hashes

#: A gram size for phrases and one for notices; the share of a notice's words that a span covers; the words that may lie
#: between two segments of a span.
SHORT, LONG, SHARE, GAP = 2, 4, 0.75, 60
#: The hash that every text has, so that texts without hits stay.
ALWAYS = 0
#: Texts of this many bytes are hashed at once, and hashes in one cell.
SLICE_BYTES, CELL = 1 << 20, 1 << 17


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str
    base: bool = False
    #: Words of the text that a span must cover, without others between them.
    must: str = ""

    @property
    def words(self) -> list[str]:
        return re.findall(r"[0-9a-z]+", self.text.lower())

    @property
    def k(self) -> int:
        return SHORT if self.base else LONG

    @property
    def needed(self) -> list[int]:
        """The places of the words of ``must``."""
        words, must = self.words, re.findall(r"[0-9a-z]+", self.must.lower())
        at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
        return list(range(at, at + len(must)))


_FREE = "is free software: you can redistribute it and/or modify it under the terms of the"
_BY = "as published by the Free Software Foundation, either version"
_LATER = "of the License, or (at your option) any later version"
_CLAIM = "in no event shall the authors or copyright holders be liable for any claim, damages or other liability"

#: Identifiers of the SPDX list by label.
SPDX = {
    "agpl": "AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0", "apache": "Apache-1.1 Apache-2.0", "artistic": "Artistic-1.0 Artistic-2.0",
    "boost": "BSL-1.0", "bsd": "0BSD BSD-2-Clause BSD-3-Clause BSD-4-Clause", "cc0": "CC0-1.0", "cddl": "CDDL-1.0 CDDL-1.1",
    "epl": "EPL-1.0 EPL-2.0", "eupl": "EUPL-1.1 EUPL-1.2", "gpl": "GPL-2.0-only GPL-2.0-or-later GPL-2.0 GPL-3.0-only GPL-3.0-or-later GPL-3.0",
    "isc": "ISC", "lgpl": "LGPL-2.1-only LGPL-2.1-or-later LGPL-2.1 LGPL-3.0-only LGPL-3.0-or-later LGPL-3.0", "mit": "MIT MIT-0",
    "mpl": "MPL-1.1 MPL-2.0", "unlicense": "Unlicense", "wtfpl": "WTFPL", "zlib": "Zlib",
}
#: The attribution licences of Creative Commons, and their versions with the names of their long form.
CC_PARTS = {"by": "Attribution", "sa": "ShareAlike", "nc": "NonCommercial", "nd": "NoDerivatives"}
CC_KINDS = "by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"
CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def made_templates() -> list[Template]:
    """A template for each identifier, and for each Creative Commons licence in each version, short and long."""
    out = [
        Template(f"spdx_{i}", label, f"SPDX-License-Identifier: {i}", must=i) for label, ids in SPDX.items() for i in ids.split()
    ]
    for kind in CC_KINDS:
        long = "-".join(CC_PARTS[part] for part in kind.split("-"))
        for version, name in CC_VERSIONS.items():
            out.append(Template(f"spdx_cc_{kind}_{version}", f"cc-{kind}", f"SPDX-License-Identifier: CC-{kind.upper()}-{version}", must=f"CC-{kind.upper()}-{version}"))
            if version != "4.0":  # those stand above
                out.append(Template(f"cc_{kind}_{version}", f"cc-{kind}", f"Licensed under CC {kind.upper()} {version}", must=f"{kind.upper()} {version}"))
                out.append(Template(f"cc_{kind}_{version}_long", f"cc-{kind}", f"This work is licensed under a Creative Commons {long} {version} {name} License", must=f"{long} {version}"))
    return out


#: Phrases, then the public wording of license notices.
TEMPLATES = (
    Template("mit_phrase", "mit", "MIT License", True),
    Template("apache_phrase", "apache", "Apache License", True),
    Template("gpl_phrase", "gpl", "General Public License", True),
    Template("mit_release", "mit", "Released under the MIT License"),
    Template("mit_distributed", "mit", "Distributed under the MIT License"),
    Template("apache_header", "apache", "Licensed under the Apache License, Version 2.0"),
    Template("gpl_header", "gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("cc_by_nc", "cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc_by", "cc-by", "Licensed under CC BY 4.0"),
    Template("cc_by_sa", "cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("cc_by_nd", "cc-by-nd", "Licensed under CC BY-ND 4.0"),
    Template("cc_by_nc_sa", "cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    Template("cc_by_nc_nd", "cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    Template("cc_long", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", must="Attribution 4.0"),
    Template("cc_sa_long", "cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", must="Attribution-ShareAlike 4.0"),
    Template("cc_nc_long", "cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", must="Attribution-NonCommercial 4.0"),
    Template("cc_nd_long", "cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", must="Attribution-NoDerivatives 4.0"),
    Template("cc_nc_sa_long", "cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", must="NonCommercial-ShareAlike"),
    Template("cc_nc_nd_long", "cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", must="NonCommercial-NoDerivatives"),
    Template("cc0", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    Template("cc0_dedication", "cc0", "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication", must="CC0 1.0"),
    Template("proprietary", "all-rights-reserved", "All rights reserved. No part of this publication may be reproduced"),
    Template("proprietary_long", "all-rights-reserved", "stored in a retrieval system, or transmitted in any form or by any means, without the prior written permission of the publisher"),
    Template(
        "mit_grant", "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    Template(
        "mit_disclaimer", "mit",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. The software is provided \"as is\", without warranty of any kind, express or implied, including but "
        "not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. "
        + _CLAIM,
        must="shall be included in all copies or substantial portions",
    ),
    Template(
        "apache_grant", "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        must="www.apache.org/licenses",
    ),
    Template("gpl_grant", "gpl", f"This program {_FREE} GNU General Public License {_BY} 3 {_LATER}", must="GNU General Public License"),
    Template("gpl2_grant", "gpl", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 {_LATER}", must="GNU General Public License"),
    Template("lgpl_grant", "lgpl", f"This library {_FREE} GNU Lesser General Public License {_BY} 3 {_LATER}", must="GNU Lesser General Public License"),
    Template("lgpl2_grant", "lgpl", f"This library {_FREE} GNU Lesser General Public License {_BY} 2.1 {_LATER}", must="GNU Lesser General Public License"),
    Template("agpl_grant", "agpl", f"This program {_FREE} GNU Affero General Public License {_BY} 3 {_LATER}", must="GNU Affero General Public License"),
    Template("gpl_warranty", "gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details", must="GNU General Public License"),
    Template("lgpl_header", "lgpl", "Licensed under the GNU Lesser General Public License", must="GNU Lesser General Public License"),
    Template("agpl_header", "agpl", "Licensed under the GNU Affero General Public License", must="GNU Affero General Public License"),
    Template("mpl_notice", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    Template("epl_notice", "epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", must="Eclipse Public License"),
    Template("eupl_notice", "eupl", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL", must="under the EUPL"),
    Template(
        "bsd_grant", "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    Template(
        "bsd_clauses", "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    Template(
        "bsd_endorsement", "bsd",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
    ),
    Template("bsd_header", "bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", must="BSD-style license"),
    Template(
        "isc_grant", "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template(
        "unlicense", "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means",
    ),
    Template(
        "zlib", "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ),
    Template(
        "boost", "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit "
        "the Software, and to prepare derivative works of the Software",
        must="any person or organization obtaining",
    ),
    Template("boost_header", "boost", "Distributed under the Boost Software License, Version 1.0", must="Boost Software License"),
    Template("wtfpl", "wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", must="as long as the name is changed"),
    Template("artistic", "artistic", "you can redistribute it and/or modify it under the terms of the Artistic License", must="Artistic License"),
    # Parts of whole licence texts.
    Template(
        "apache_copyright_grant", "apache",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, "
        "non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, "
        "publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
        must="copyright license to reproduce, prepare Derivative Works of",
    ),
    Template("apache_definitions", "apache", "License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document", must="Sections 1 through 9"),
    Template(
        "gpl_preamble", "gpl",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for "
        "most software and other practical works are designed to take away your freedom to share and change the works. By "
        "contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program",
        must="GNU General Public License is a free",
    ),
    Template(
        "gpl2_preamble", "gpl",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU "
        "General Public License is intended to guarantee your freedom to share and change free software",
        must="GNU General Public License is intended",
    ),
    Template(
        "agpl_preamble", "agpl",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, "
        "specifically designed to ensure cooperation with the community in the case of network server software",
        must="GNU Affero General Public License",
    ),
    Template(
        "lgpl_body", "lgpl",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU "
        "General Public License, supplemented by the additional permissions listed below",
        must="GNU Lesser General Public License",
    ),
    Template(
        "mpl_grants", "mpl",
        "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license under intellectual property "
        "rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, "
        "display, perform, distribute, and otherwise exploit its Contributions",
        must="Licensable by such Contributor",
    ),
    Template("epl_header", "epl", "The accompanying program is provided under the terms of this Eclipse Public License", must="Eclipse Public License"),
    Template(
        "cc0_body", "cc0",
        "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights "
        "(defined below) upon the creator and subsequent owner(s) (each and all, an owner) of an original work of authorship",
        must="automatically confer exclusive Copyright and Related Rights",
    ),
    *(
        Template(
            f"cc_{kind}_code", f"cc-{kind}",
            "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of "
            f"this Creative Commons {'-'.join(CC_PARTS[part] for part in kind.split('-'))} 4.0 International Public License",
            must=f"{'-'.join(CC_PARTS[part] for part in kind.split('-'))} 4.0",
        )
        for kind in CC_KINDS
    ),
    *made_templates(),
)

GRAMS = "template string, label string, base boolean, length int, k int, at int, hash bigint"


def text_words(text: str | None) -> list[bytes]:
    return _WORDS((text or "").encode("utf-8", "surrogatepass").lower())


_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def template_grams(templates=TEMPLATES) -> list[tuple]:
    """The rows of GRAMS: every k-gram of every template, and one row for the hash that every text has."""
    out: list[tuple] = [(None, None, None, None, None, None, ALWAYS)]
    for t in templates:
        hashes = gram_hashes(word_hashes.of([w.encode() for w in t.words]), t.k).view(np.int64)
        out += [(t.name, t.label, t.base, len(t.words), t.k, i, h) for i, h in enumerate(hashes.tolist())]
    return out


def hits(docs: DataFrame, id_col: str, text_col: str, templates=TEMPLATES) -> DataFrame:
    """A row for every k-gram of a text that stands in a template, and one with a null template for every text."""
    sizes = sorted({t.k for t in templates})

    def scan(batches):
        for batch in batches:
            rows, size = [], 0
            for i, cell in enumerate(batch.column(1), 1):
                text = cell.as_py()
                words = word_hashes.of(text_words(text))
                rows.append((i - 1, len(words), 0, np.full(1, ALWAYS, np.uint64)))
                for k in sizes:
                    grams = gram_hashes(words, k)
                    rows += [(i - 1, len(words), at, grams[at : at + CELL]) for at in range(0, len(grams), CELL)]
                size += len(text or "")
                if size >= SLICE_BYTES or i == batch.num_rows:
                    ends = np.cumsum([0, *(len(r[3]) for r in rows)])
                    at = pa.array([r[0] for r in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(at),
                            batch.column(2).take(at),
                            pa.array([r[1] for r in rows], pa.int64()),
                            pa.array([r[2] for r in rows], pa.int64()),
                            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([r[3] for r in rows]).view(np.int64))),
                        ],
                        names=["doc_id", "row_id", "n_words", "first", "hashes"],
                    )
                    rows, size = [], 0

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("row_id", F.monotonically_increasing_id())
    met = texts.mapInArrow(scan, "doc_id bigint, row_id bigint, n_words bigint, first bigint, hashes array<bigint>")
    grams = met.select("doc_id", "row_id", "n_words", "first", F.posexplode("hashes").alias("spot", "hash"))
    table = docs.sparkSession.createDataFrame(template_grams(templates), GRAMS)
    # The templates are a fixed table of some thousand rows, so it may be broadcast.
    return grams.join(F.broadcast(table), "hash").select(
        "doc_id", "row_id", "n_words", "template", "label", "base", "length", "k", "at", (F.col("first") + F.col("spot")).cast("int").alias("pos")
    )


def align(segments: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """The chain of ``(position, template place, words)`` that covers most template words, in order on both sides.

    Where a segment overlaps the one before, in the text or in the template, its overlapping head is cut off.
    """
    segments = sorted(segments)
    best: list[tuple[int, int, tuple]] = []  # words covered, the segment before, the segment as cut
    for j, (pos, at, n) in enumerate(segments):
        mine = (n, -1, (pos, at, n))
        for i in range(j):
            p, a, m = best[i][2]
            cut = max(0, p + m - pos, a + m - at)
            if cut < n and at > a and pos + cut - (p + m) <= gap and best[i][0] + n - cut > mine[0]:
                mine = (best[i][0] + n - cut, i, (pos + cut, at + cut, n - cut))
        best.append(mine)
    out, j = [], max(range(len(best)), key=lambda i: best[i][0], default=-1)
    while j >= 0:
        out.append(best[j][2])
        j = best[j][1]
    return out[::-1]


def spans(votes: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``row_id, template, label, first, last, share, found`` for the spans of notices.

    A span of a template of n words is no longer than ``2 n + GAP``. Segments are grouped by stretches of that length,
    each with the next one, so that every span lies in the group of the stretch where it begins.
    """
    by_name = {t.name: t for t in templates}
    width = 2 * F.col("length") + GAP
    bucket = lambda d, at: F.floor((d + at) / width).cast("bigint")
    pieces = votes.filter("NOT base").select(
        "row_id", "template", "length", "diagonal", F.explode("ats").alias("at")
    ).withColumn("bucket", bucket(F.col("diagonal"), F.col("at")))
    grouped = (
        pieces.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)))
        .groupBy("row_id", "template", "bucket")
        .agg(F.collect_list(F.struct("diagonal", "at")).alias("spots"))  # the stretch and the template bound them
    )

    def verify(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                t = by_name[row["template"]]
                n, need = len(t.words), t.needed if t.must else []
                width, runs = 2 * n + GAP, []
                for d, at in sorted((s["diagonal"], s["at"]) for s in row["spots"]):
                    if runs and runs[-1][0] - runs[-1][1] == d and runs[-1][1] + runs[-1][2] - t.k + 1 == at:
                        runs[-1] = (runs[-1][0], runs[-1][1], runs[-1][2] + 1)
                    else:
                        runs.append((d + at, at, t.k))
                while runs:
                    chain = align(runs, GAP)
                    while chain and chain[-1][0] + chain[-1][2] - chain[0][0] > width:
                        chain.pop()
                    words = {a + i: p + i for p, a, m in chain for i in range(m)}
                    # The words that tell a notice from others must stand together, or "Attribution 4.0" would be in all kinds.
                    told = all(w in words for w in need) and all(words[b] - words[a] == 1 for a, b in zip(need, need[1:]))
                    first, last = chain[0][0], chain[-1][0] + chain[-1][2] - 1
                    share = len(words) / n
                    if row["bucket"] * width <= first < (row["bucket"] + 1) * width:
                        out.append((row["row_id"], t.name, t.label, first, last, share, share >= SHARE and told))
                    if share < SHARE:
                        break
                    runs = [r for r in runs if r[0] > last or r[0] + r[2] <= first]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)],
                names=["row_id", "template", "label", "first", "last", "share", "found"],
            )

    return grouped.mapInArrow(verify, "row_id bigint, template string, label string, first int, last int, share double, found boolean")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """Labels, places and spans of license notices for every text.

    ``base_labels`` come from the base phrases alone, ``labels`` also from verified spans of notices. ``score`` is the
    best covered share over all notices, 1 for a whole phrase, 0 without a hit. ``spans`` lists template, first word,
    last word and share of every verified span.
    """
    met = hits(docs, id_col, text_col, templates)
    votes = met.groupBy("doc_id", "row_id", "n_words", "template", "label", "base", "length", "k", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats")  # at most as many as the template has grams
    )
    votes, _ = materialize(votes, "votes")
    whole = F.col("base") & (F.size("ats") == F.col("length") - F.col("k") + 1)
    places = votes.filter(F.col("template").isNull() | whole).select(
        "row_id", F.when(F.col("template").isNull(), F.struct("doc_id", "n_words")).alias("text"), F.when(whole, F.col("diagonal")).alias("start"),
        F.when(whole, F.col("label")).alias("base_label"), F.lit(None).cast("string").alias("label"), F.when(whole, 1.0).alias("share"),
        F.lit(None).cast("struct<template:string,first:int,last:int,share:double>").alias("span"),
    )
    found = spans(votes, templates).select(
        "row_id", F.lit(None).cast("struct<doc_id:bigint,n_words:bigint>").alias("text"), F.lit(None).cast("int").alias("start"),
        F.lit(None).cast("string").alias("base_label"), F.when(F.col("found"), F.col("label")).alias("label"), "share",
        F.when(F.col("found"), F.struct("template", "first", "last", "share")).alias("span"),
    )
    names = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.collect_set(x) for x in c)))), ",")
    return (
        places.unionByName(found)
        .groupBy("row_id")
        .agg(
            F.max("text").alias("text"),
            F.count("start").cast("bigint").alias("n_base"),
            F.min("start").cast("bigint").alias("first_word"),
            F.max("start").cast("bigint").alias("last_word"),
            names("base_label").alias("base_labels"),
            names("base_label", "label").alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_set("span")).alias("spans"),
        )
        .select("text.doc_id", "text.n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    )
