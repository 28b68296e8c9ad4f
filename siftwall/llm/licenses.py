"""Licence scans: TF-IDF cosine of notices to templates, inherited along directories."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import attach

#: The usual one-line notices of each licence, under its SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause Simplified License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause New or Revised License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Released under the ISC License.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain, Unlicense.",
}
#: Words of notices; nothing is left out by them, since every line and window is scored.
MARKERS = ("licens", "licenc", "spdx", "public domain")

_FSF = (
    "Everyone is permitted to copy and distribute verbatim copies of this license document,"
    " but changing it is not allowed."
)
_GNU = (
    "This {what} is free software; you can redistribute it and/or modify it under the terms of the"
    " GNU {name}General Public License as published by the Free Software Foundation; either version"
    " {version} of the License, or (at your option) any later version."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted"
    " provided that the following conditions are met: 1. Redistributions of source code must retain"
    " the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of"
    " conditions and the following disclaimer in the documentation and/or other materials provided"
    " with the distribution."
)
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR"
    " IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY"
    " AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_CC = (
    "This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy"
    " of this license, visit http://creativecommons.org/licenses/{short}/4.0/ or send a letter to"
    " Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
)
_CC_OPEN = (
    "Creative Commons {name} 4.0 International Public License By exercising the Licensed Rights"
    " (defined below), You accept and agree to be bound by the terms and conditions of this Creative"
    " Commons {name} 4.0 International Public License (\"Public License\")."
)
_CC_KINDS = {
    "CC-BY-4.0": ("Attribution", "by"),
    "CC-BY-SA-4.0": ("Attribution-ShareAlike", "by-sa"),
    "CC-BY-NC-4.0": ("Attribution-NonCommercial", "by-nc"),
    # not among the notices, but else they would be taken for one of the three above
    "CC-BY-ND-4.0": ("Attribution-NoDerivatives", "by-nd"),
    "CC-BY-NC-SA-4.0": ("Attribution-NonCommercial-ShareAlike", "by-nc-sa"),
    "CC-BY-NC-ND-4.0": ("Attribution-NonCommercial-NoDerivatives", "by-nc-nd"),
}
#: Standard headers and the opening text of licence files, several of a licence.
TEXTS = [
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except"
        " in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in"
        " writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT"
        " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR"
        " USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute,"
        " sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions:",
    ),
    ("BSD-2-Clause", _BSD + _BSD_END),
    (
        "BSD-3-Clause",
        _BSD
        + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to"
        " endorse or promote products derived from this software without specific prior written permission."
        + _BSD_END,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without"
        " fee is hereby granted, provided that the above copyright notice and this permission notice appear"
        " in all copies.",
    ),
    ("GPL-2.0", _GNU.format(what="program", name="", version="2")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. " + _FSF),
    ("GPL-3.0", _GNU.format(what="program", name="", version="3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _FSF),
    ("AGPL-3.0", _GNU.format(what="program", name="Affero ", version="3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _FSF),
    ("LGPL-2.1", _GNU.format(what="library", name="Lesser ", version="2.1")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. " + _FSF),
    # not among the notices, but else it would be taken for another of the GNU licences
    ("LGPL-3.0", _GNU.format(what="library", name="Lesser ", version="3")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _FSF),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of"
        " the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "MPL-2.0",
        "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or"
        " legal entity that creates, contributes to the creation of, or owns Covered Software.",
    ),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring"
        " rights to this work. http://creativecommons.org/publicdomain/zero/1.0/",
    ),
    (
        "CC0-1.0",
        "CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES."
        " DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP.",
    ),
    *[(name, _CC.format(name=long, short=short)) for name, (long, short) in _CC_KINDS.items()],
    *[(name, _CC_OPEN.format(name=long)) for name, (long, _) in _CC_KINDS.items()],
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy,"
        " modify, publish, use, compile, sell, or distribute this software, either in source code form or as"
        " a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]
#: Identifiers of SPDX tags, in lower case; tags are read rather than scored.
SPDX = {
    name.lower(): name
    for name in (*TEMPLATES, "LGPL-3.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0")
}
SPDX |= {
    f"{name.lower()}{end}": name for name in SPDX.values() if "GPL" in name for end in ("-only", "-or-later", "+")
}
#: Words so common that a text with no other word of the templates has no notice: in every
#: template their share of the squared weight is below ``MIN_COSINE ** 2``, and no cosine is
#: higher than the root of the share that a text's words have.
COMMON = frozenset(
    "a all and are as at be by for from in is it its not of on one so that the this to"
    " was with".split()
)
#: Names of files that hold the licence of their directory.
LICENCE_FILES = r"^(?i)(licen[sc]e|copying|unlicense|notice)([.\-_].*)?$"
#: Least cosine of a notice.
MIN_COSINE = 0.6
#: Different words that a notice shares with its template; a single word is none.
MIN_SHARED = 2

_TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"


def _counted(texts: list[str]) -> tuple[list[dict[str, float]], dict[str, float], float]:
    counts = [Counter(re.findall(_TOKEN, text.lower())) for text in texts]
    total = len(counts)
    seen = Counter(token for c in counts for token in c)
    idf = {token: math.log((1 + total) / (1 + df)) + 1 for token, df in seen.items()}
    vectors = []
    for c in counts:
        raw = {token: n * idf[token] for token, n in c.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        vectors.append({token: v / norm for token, v in raw.items()})
    return vectors, idf, math.log(1 + total) + 1


def template_weights() -> tuple[dict[str, dict[str, float]], dict[str, float], float]:
    """Unit TF-IDF vector of each one-line notice, idf of each token, and that of any other."""
    vectors, idf, other = _counted(list(TEMPLATES.values()))
    return dict(zip(TEMPLATES, vectors)), idf, other


def text_weights() -> tuple[list[dict[str, float]], dict[str, float], float]:
    """The same for TEXTS, in their order."""
    return _counted([text for _, text in TEXTS])


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value made once: a one-element array binds it to a name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + of(x))


def _scored(text: Column) -> Column:
    """Every line and window that fits a template: ``array<struct<line, score, licence>>``."""
    short, long = template_weights(), text_weights()
    sizes = [len(re.findall(_TOKEN, text.lower())) for text in (*TEMPLATES.values(), *[t for _, t in TEXTS])]
    names = [*TEMPLATES, *[name for name, _ in TEXTS]]
    literal = json.dumps(
        [
            {"licence": name, "n": n, "long": k >= len(TEMPLATES), "v": v}
            for k, (name, n, v) in enumerate(zip(names, sizes, [*short[0].values(), *long[0]]))
        ]
    )
    templates = F.from_json(
        F.lit(literal), "array<struct<licence: string, n: int, long: boolean, v: map<string, double>>>"
    )
    vocabulary = sorted(short[1].keys() | long[1].keys())
    idfs = [F.from_json(F.lit(json.dumps(idf)), "map<string, double>") for _, idf, _ in (short, long)]
    least_square = MIN_COSINE * MIN_COSINE - 1e-9

    def idf(t: Column, k: int) -> Column:
        other = F.lit((short, long)[k][2])
        return F.when(t.isin(vocabulary), F.coalesce(F.try_element_at(idfs[k], t), other)).otherwise(other)

    tokens = F.flatten(
        F.transform(
            F.split(F.lower(text), "\n"),
            lambda x, i: F.transform(
                F.regexp_extract_all(x, F.lit(_TOKEN), F.lit(0)),
                lambda t: F.struct(t.alias("t"), i.alias("line"), idf(t, 0).alias("s"), idf(t, 1).alias("l")),
            ),
        )
    )

    def fits(m: Column, tokens: Column, lines: Column) -> Column:
        """Lines and windows whose cosine to one template is high enough."""

        def weighted(x: Column) -> Column:
            i = F.when(m["long"], x["l"]).otherwise(x["s"])
            v = F.when(x["t"].isin(vocabulary), F.try_element_at(m["v"], x["t"]))
            return F.struct(
                x["t"].alias("t"), x["line"].alias("line"), i.alias("i"), (F.coalesce(v, F.lit(0.0)) * i).alias("g")
            )

        def units(ws: Column) -> Column:
            n = F.size(ws)
            width = F.least(m["n"], n)
            # a window lies in two blocks of its width, and its norm is at least the root of that
            blocks = F.filter(
                F.sequence(F.lit(0), n - width, width),
                lambda b: _sum(F.slice(ws, b + 1, 2 * width), lambda w: w["g"])
                >= MIN_COSINE * F.sqrt(width.cast("double")) - 1e-9,
            )
            windows = F.flatten(F.transform(blocks, lambda b: F.sequence(b, F.least(b + width - 1, n - width))))
            ranges = F.concat(
                lines, F.transform(windows, lambda s: F.struct(s.alias("at"), width.alias("n")))
            )
            found = F.transform(ranges, lambda r: _let(F.slice(ws, r["at"] + 1, r["n"]), cosine))
            return F.filter(found, lambda x: F.coalesce(x["score"] >= MIN_COSINE, F.lit(False)))

        def cosine(ws: Column) -> Column:
            dot, squares = _sum(ws, lambda w: w["g"]), _sum(ws, lambda w: w["i"] * w["i"])

            def exact(d: Column) -> Column:
                norm = F.sqrt(
                    _sum(ws, lambda w: w["i"] * w["i"] * F.size(F.filter(ws, lambda u: u["t"] == w["t"])))
                )
                return F.struct(
                    F.get(ws, F.lit(0))["line"].alias("line"),
                    F.round(d / norm, 9).alias("score"),
                    m["licence"].alias("licence"),
                )

            # squares of single tokens are at most those of equal ones together
            shared = F.size(F.array_distinct(F.transform(F.filter(ws, lambda w: w["g"] > 0), lambda w: w["t"])))
            return _let(
                dot,
                lambda d: F.when((d * d >= least_square * squares) & (d > 0) & (shared >= MIN_SHARED), exact(d)),
            )

        return _let(F.transform(tokens, weighted), units)

    def of_text(chosen: Column) -> Column:
        def placed(tokens: Column) -> Column:
            places = F.filter(
                F.sequence(F.lit(0), F.size(tokens) - 1),
                lambda i: (i == 0) | (F.get(tokens, i)["line"] != F.get(tokens, i - 1)["line"]),
            )

            def ranges(p: Column) -> Column:
                return F.transform(
                    p,
                    lambda s, k: F.struct(
                        s.alias("at"), (F.coalesce(F.get(p, k + 1), F.size(tokens)) - s).alias("n")
                    ),
                )

            return _let(
                _let(places, ranges),
                lambda lines: F.flatten(F.transform(chosen, lambda m: fits(m, tokens, lines))),
            )

        return F.when(F.size(chosen) > 0, _let(tokens, placed))

    def possible(present: Column) -> Column:
        """The templates of whose squared weight a text's words hold enough."""

        def enough(m: Column) -> Column:
            vs = F.filter(F.transform(present, lambda t: F.try_element_at(m["v"], t)), F.isnotnull)
            return _let(
                vs, lambda vs: (F.size(vs) >= MIN_SHARED) & (_sum(vs, lambda v: v * v) >= least_square)
            )

        return F.filter(templates, enough)

    def strings(values: list[str]) -> Column:
        return F.from_json(F.lit(json.dumps(values)), "array<string>")

    def of_words(words: Column) -> Column:
        found = _let(_let(F.array_intersect(words, strings(vocabulary)), possible), of_text)
        return F.when(F.arrays_overlap(words, strings([t for t in vocabulary if t not in COMMON])), found)

    none = F.lit([]).cast("array<struct<line: int, score: double, licence: string>>")
    return F.coalesce(_let(F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0)), of_words), none)


def _tagged(text: Column) -> Column:
    """What SPDX tags name, at score 1: the first known identifier of each tag."""
    known = F.from_json(F.lit(json.dumps(SPDX)), "map<string, string>")

    def named(x: Column, i: Column) -> Column:
        after = F.regexp_extract(x, r"spdx-license-identifier:(.*)", 1)
        ids = F.transform(
            F.regexp_extract_all(after, F.lit(r"[a-z0-9.+-]+"), F.lit(0)), lambda t: F.try_element_at(known, t)
        )
        return F.struct(
            i.alias("line"), F.lit(1.0).alias("score"), F.get(F.filter(ids, F.isnotnull), F.lit(0)).alias("licence")
        )

    tags = F.filter(F.transform(F.split(F.lower(text), "\n"), named), lambda x: x["licence"].isNotNull())
    none = F.lit([]).cast("array<struct<line: int, score: double, licence: string>>")
    return F.when(F.contains(F.lower(text), F.lit("spdx-license-identifier:")), tags).otherwise(none)


def _notices(text: Column) -> Column:
    """The best notice that begins on each line: ``array<struct<line, score, licence>>``."""
    found = F.sort_array(F.concat(_tagged(text), _scored(text)))
    return _let(
        found,
        lambda all_: F.filter(all_, lambda x, i: F.coalesce(F.get(all_, i + 1)["line"] != x["line"], F.lit(True))),
    )


def own_licences(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Every row with ``path, notices, own``: all notices of its text, and the best one.

    Scored are all lines and, over the whole text, all windows as long as a template in
    words, so that wrapped, embedded and full texts count like one-line notices. Whatever is
    passed over is shown beforehand to score below MIN_COSINE. One pass without a shuffle.
    Of equal scores the earlier line wins.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = files.select("*", _notices(text).alias("notices"))
    order = F.array_sort(
        "notices",
        lambda a, b: F.when(a["score"] > b["score"], -1)
        .when(a["score"] < b["score"], 1)
        .otherwise(a["line"] - b["line"]),
    )
    return found.withColumn("own", F.get(order, F.lit(0)))


def scan_licences(
    files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text"
) -> DataFrame:
    """``id, path, own_licence, own_score, licence, inherited_from, is_licence_file`` per row.

    A file's own notice counts first. Files without one inherit from the nearest directory
    at or above their own that has a licence file (by name) with a notice; of several such
    files the best score decides, then the name of the licence. Null texts have no notice, a null path is in no
    directory, repeated rows give repeated results, and an empty table gives none.

    Inheritance is settled once per directory, by a join of directories with their
    ancestors; files meet only their own directory's row, and directories with very many
    files do not gather in one task.
    """
    path = F.coalesce(F.col(path_col), F.lit(""))
    rows = stage(
        own_licences(files.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).alias("text")), "path", "text")
        .select(
            "id",
            "path",
            F.col("own.licence").alias("own_licence"),
            F.col("own.score").alias("own_score"),
            F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"),
            F.rlike(F.element_at(F.split("path", "/"), -1), F.lit(LICENCE_FILES)).alias("is_licence_file"),
            F.monotonically_increasing_id().alias("k"),
        ),
        "licence-rows",
    )
    governing = (
        rows.where("is_licence_file AND own_licence IS NOT NULL")
        .groupBy(F.col("dir").alias("above"))
        .agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_licence").alias("l")))["l"].alias("l"))
    )
    dirs = stage(rows.groupBy("dir").agg(F.count("*").alias("c")), "licence-all-dirs")
    parts = F.split("dir", "/")
    # the root of the tree, "", is an ancestor of all
    ancestors = dirs.select(
        "dir",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size(parts)),
                lambda i: F.struct(
                    i.alias("depth"),
                    F.when(i == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(i, F.lit(1))), "/")).alias("above"),
                ),
            )
        ).alias("a"),
    ).select("dir", "a.depth", "a.above")
    # a directory near the root has all others below it
    below = stage(
        ancestors.groupBy("above").agg(F.count("*").alias("size")).join(governing, "above"), "licence-above"
    )
    nearest = (
        attach(ancestors, below, ["above"], "size", F.col("dir"))
        .where("l IS NOT NULL")
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "above", "l")).alias("n"))
    )
    settled = stage(
        dirs.join(nearest, "dir", "left").select(
            "dir", "c", F.col("n.l").alias("given"), F.col("n.above").alias("from_dir")
        ),
        "licence-dirs",
    )
    joined = attach(rows, settled, ["dir"], "c", F.col("k"))
    inherits = F.col("own_licence").isNull() & (F.col("path") != "")
    return joined.select(
        "id",
        "path",
        "own_licence",
        "own_score",
        F.coalesce("own_licence", F.when(inherits, F.col("given"))).alias("licence"),
        F.when(inherits, F.col("from_dir")).alias("inherited_from"),
        "is_licence_file",
    )
