"""Licence scan: TF-IDF cosine to templates, and inheritance from the nearest directory."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, spread

#: Notices by SPDX identifier (fixed values): the sentences by which files name their licence, and the openings
#: and main sentences of headers and licence files.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License);",
        "Apache License Version 2.0, January 2004",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
        "The ASF licenses this file to You under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "BSD-2-Clause": (
        "BSD 2-Clause License",
        "Released under the BSD 2-Clause License.",
        "The 2-Clause BSD License, the Simplified BSD License",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "BSD 3-Clause License",
        "The 3-Clause BSD License, the New BSD License",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "Artistic-2.0": ("The Artistic License 2.0", "Licensed under the Artistic License 2.0."),
    "BSL-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Distributed under the Boost Software License, Version 1.0.",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    "CC0-1.0": (
        "CC0 1.0 Universal",
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, which is dedicated to the public domain under CC0 1.0.",
    ),
    "EPL-1.0": (
        "Eclipse Public License - v 1.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
        "Licensed under the Eclipse Public License 1.0.",
    ),
    "EUPL-1.2": ("European Union Public Licence v. 1.2", "Licensed under the EUPL, Version 1.2."),
    "EPL-2.0": (
        "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License 2.0.",
    ),
    "ISC": (
        "ISC License",
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
        "MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "MIT-0": ("MIT No Attribution", "Released under the MIT No Attribution License."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0",
    ),
    "PSF-2.0": ("Python Software Foundation License Version 2", "Licensed under the Python Software Foundation License Version 2."),
    "Zlib": (
        "zlib License",
        "Licensed under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
#: The GNU licences: SPDX name, what it is called, short name, version and date. Every version has the same
#: notices, so that the version decides between them.
GNU = (
    ("AGPL-3.0", "Affero General", "AGPL", "3", "19 November 2007"),
    ("GPL-2.0", "General", "GPL", "2", "June 1991"),
    ("GPL-3.0", "General", "GPL", "3", "29 June 2007"),
    ("LGPL-2.0", "Library General", "LGPL", "2", "June 1991"),
    ("LGPL-2.1", "Lesser General", "LGPL", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser General", "LGPL", "3", "29 June 2007"),
)
for _spdx, _called, _short, _v, _date in GNU:
    _granted = f"it under the terms of the GNU {_called} Public License as published by the Free Software Foundation, either version {_v} of the License"
    TEMPLATES[_spdx] = tuple(dict.fromkeys((
        *TEMPLATES.get(_spdx, ()),
        f"GNU {_called} Public License Version {_v}, {_date}",
        f"This work is licensed under the GNU {_called} Public License, version {_v}.",
        f"Licensed under the GNU {_short} v{_v}.",
        f"You can redistribute it and/or modify {_granted}.",
        *(f"This {x} is free software: you can redistribute it and/or modify {_granted}, or (at your option) any later version." for x in ("program", "library")),
        f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {_called} Public License version {_v} as published by the Free Software Foundation.",
    )))
#: The Creative Commons licences: what is added to BY, what that is called, and the versions.
COMMONS = (("", ""), ("-NC", "-NonCommercial"), ("-NC-ND", "-NonCommercial-NoDerivatives"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-ND", "-NoDerivatives"), ("-SA", "-ShareAlike"))
for (_short, _called), (_v, _where) in product(COMMONS, (("3.0", "Unported"), ("4.0", "International"))):
    TEMPLATES[f"CC-BY{_short}-{_v}"] = (
        f"Licensed under CC BY{_short} {_v}.",
        f"This work is licensed under a Creative Commons Attribution{_called} {_v} {_where} License.",
        f"Creative Commons Attribution{_called} {_v} {_where} Public License",
    )
#: Tags name a licence by its identifier, of the GNU licences also by what it grants.
for _spdx in sorted(TEMPLATES):
    _names = [_spdx, *(f"{_spdx}-{x}" for x in ("only", "or-later") if "GPL" in _spdx)]
    TEMPLATES[_spdx] += tuple(f"SPDX-License-Identifier: {x}" for x in _names)
#: What a sentence must hold to be compared at all (fixed values).
CUES = ("licen", "redistribution", "permission is hereby granted", "permission is granted", "permission to use, copy", "public domain", "cc0", "as-is", "no attribution")
#: File names that speak for their directory.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([-._].*)?$"
SENTENCE_END = re.compile(r"(?<=[.;!?])\s+(?=[A-Z\"(])|\n+")
#: In a paragraph whose lines are joined, lists also end a sentence.
JOINED_END = re.compile(r"(?<=[.;!?])\s+(?=[A-Z\"(])|(?<=:)\s+|\s+(?=\d+[.)]\s+[A-Z])")
#: What begins a line of a comment, or ends one.
COMMENT = re.compile(r"^[ \t]*(?:/\*+|\*+/|\*+(?=\s|$)|//+|#+|;+|--+|<!--|%+|dnl\b|\.\.(?=\s))?[ \t]*|[ \t]*(?:\*+/|-->)?[ \t\r]*$")
#: The clauses that the BSD licences share, and what only that of three clauses has.
BSD_BINARY, BSD_THIRD = "in binary form must reproduce the above copyright", re.compile(r"neither the names?\b|endorse or promote|\b3-clause\b")


#: An identifier's tag with its expression, and a sentence that grants several licences.
TAG = re.compile(r"SPDX-License-Identifier:[ \t]*(.+)", re.I)
GRANT = re.compile(r"\blicensed under (?:the terms of )?(?:either |both |any )?(?:of )?(?:the )?(?P<names>.+)", re.I | re.S)
BETWEEN = re.compile(r",? (?:or|and|and/or)(?: the)? |; ?", re.I)


def expression(text: str) -> list[str]:
    """The identifiers of an SPDX expression, up to where its grammar ends; exceptions (WITH) name no licence."""
    names, expected = [], "name"
    for token in re.findall(r"[A-Za-z0-9.+-]+", text):
        if token.upper() in ("AND", "OR"):
            expected = "name"
        elif token.upper() == "WITH":
            expected = "exception"
        elif expected == "name":
            names.append(re.sub(r"\+$", "-or-later", token))
            expected = None
        elif expected == "exception":
            expected = None
        else:
            break
    return names


def alternatives(sentence: str) -> list[str]:
    """A sentence of the templates' form for each licence of an expression, or of a grant that names several.

    Empty where it says but one thing, and is compared as it is.
    """
    if tag := TAG.search(sentence):
        names = expression(tag[1])
        return [f"SPDX-License-Identifier: {n}" for n in names] if names != tag[1].split() else []
    grant = GRANT.search(sentence)
    parts = [p.strip(" .,;()") for p in BETWEEN.split(grant["names"])] if grant else []
    return [f"Licensed under the {p}." for p in parts if p] if len(parts) > 1 else []


def sentences(text: str) -> Iterator[str]:
    """The sentences of each line, and those of each paragraph with its wrapped lines joined, without comment marks."""
    yield from SENTENCE_END.split(text)
    block: list[str] = []
    for line in [*text.split("\n"), ""]:
        bare = COMMENT.sub("", line)
        if bare:
            block.append(bare)
            continue
        if len(block) > 1 or (block and ":" in block[0]):
            joined = " ".join(block)
            if any(c in joined.lower() for c in CUES):
                yield from JOINED_END.split(joined)
        block = []


def terms(sentence: str) -> Counter:
    return Counter(re.findall(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*", sentence.lower()))


def versions(counts: Counter) -> set[str]:
    """The terms that read as the number of a version; years don't."""
    return {t.removeprefix("v") for t in counts if re.fullmatch(r"v?\d{1,2}(\.\d+)*", t)}


class Matcher:
    """Sparse TF-IDF vectors of the templates; unknown terms weigh as terms of no template."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        counts = [(name, terms(x)) for name in sorted(templates) for x in templates[name]]
        df = Counter(t for _, c in counts for t in c)
        self.most = math.log(1 + len(counts)) + 1
        self.idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
        self.vectors = [(name, self.vector(c)) for name, c in counts]
        self.versions = [versions(c) for _, c in counts]
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, (_, vector) in enumerate(self.vectors):
            for t, v in vector.items():
                self.postings[t].append((k, v))

    def vector(self, counts: Counter) -> dict[str, float]:
        x = {t: n * self.idf.get(t, self.most) for t, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
        return {t: v / norm for t, v in x.items()}

    def best(self, sentence: str) -> tuple[float, str]:
        """The highest cosine and its licence."""
        return next(iter(self.ranked(sentence)), (0.0, ""))

    def ranked(self, sentence: str) -> list[tuple[float, str]]:
        """The two licences of the highest cosines; templates of another version than the sentence names don't count."""
        counts = terms(sentence)
        named, cosines = versions(counts), defaultdict(float)
        for t, v in self.vector(counts).items():
            for k, w in self.postings.get(t, ()):
                cosines[k] += v * w
        of: dict[str, float] = {}
        for k, x in cosines.items():
            name = self.vectors[k][0]
            if x > of.get(name, 0.0) and not (named and self.versions[k] and named.isdisjoint(self.versions[k])):
                of[name] = x
        return [(x, name) for name, x in sorted(of.items(), key=lambda s: (-round(s[1], 9), s[0]))[:2]]

    def scan(self, text: str | None, threshold: float) -> tuple[str | None, float]:
        """The licence of the best sentence of a whole text, and its cosine."""
        return self.scan_all(text, threshold)[:2]

    def scan_all(self, text: str | None, threshold: float) -> tuple[str | None, float, list[str], str | None, float]:
        """As ``scan``, with all licences that sentences name, and the best sentence's second and its distance.

        A sentence that names several licences is compared as a whole and by what it says of each.
        """
        low, found, second, named = (text or "").lower(), (0.0, ""), (0.0, None), {}
        if any(c in low for c in CUES):
            each = [s for whole in dict.fromkeys(sentences(text)) for s in (whole, *alternatives(whole))]
            for sentence in dict.fromkeys(each):
                if any(c in sentence.lower() for c in CUES):
                    first, *rest = self.ranked(sentence) or [(0.0, "")]
                    if first[0] >= threshold:
                        named[first[1]] = max(named.get(first[1], 0.0), first[0])
                    if first[0] > found[0]:
                        found, second = first, (rest or [(0.0, None)])[0]
        if "BSD-3-Clause" in named:
            flat = " ".join(COMMENT.sub("", x) for x in low.split("\n"))
            if BSD_BINARY in flat and not BSD_THIRD.search(flat):
                named["BSD-2-Clause"] = max(named.get("BSD-2-Clause", 0.0), named.pop("BSD-3-Clause"))
                if found[1] == "BSD-3-Clause":
                    found, second = (found[0], "BSD-2-Clause"), (found[0], "BSD-3-Clause")
        if found[0] < threshold:
            return None, 0.0, [], None, 0.0
        return found[1], round(found[0], 6), sorted(named), second[1], round(found[0] - second[0], 6)


#: What the scan adds.
FOUND = {"license": pa.string(), "score": pa.float64(), "licenses": pa.list_(pa.string()), "runner_up": pa.string(), "margin": pa.float64()}


def with_license(files: DataFrame, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``files`` with ``license`` (null: none reaches the threshold), ``score``, ``licenses``,
    ``runner_up`` and ``margin``; columns of these names are replaced.

    Every sentence of the whole text that has a cue is compared with every notice, within its
    line and with the wrapped lines of its paragraph joined. ``licenses`` are all that any sentence
    names (an expression or a grant may name several, a text may speak of another's), sorted;
    ``runner_up`` is the next licence of the best sentence, ``margin`` how much lower it scores.
    """
    kept = [c for c in files.columns if c not in FOUND]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher()
        for batch in batches:
            found = [matcher.scan_all(t.as_py(), threshold) for t in batch.column(at)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(FOUND.values())]
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, *columns], names=names)

    rest = [c for c in kept if c != text]
    names = [*rest, *FOUND]
    schema = ", ".join([*(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in rest), "license string", "score double", "licenses array<string>", "runner_up string", "margin double"])
    return spread(files.select(*[F.col(f"`{c}`") for c in kept])).mapInArrow(run, schema)


def directory(path: Column) -> Column:
    """What stands before the last slash; the root is empty."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` (with license, score) plus inherited, inherited_from and effective.

    A licence file speaks for its directory (of several the best score, then the least path),
    a directory for all below it unless a nearer one does. Each distinct directory is joined
    to its ancestors once, however many files it holds. ``effective`` is a file's own licence,
    else the inherited one. Null paths inherit nothing.
    """
    # The file in one column, so that no name can clash.
    whole = F.struct(*[F.col(f"`{c}`") for c in files.columns])
    rows = files.select(whole.alias("file"), directory(F.col(path)).alias("dir"), F.col(path).alias("path"), "license", "score")
    name = F.regexp_extract("path", "[^/]*$", 0)
    speaking = (
        rows.where(F.col("license").isNotNull() & name.rlike(LICENCE_FILE))
        .groupBy(F.col("dir").alias("from"))
        .agg(F.min_by("license", F.struct((-F.col("score")).alias("s"), F.col("path").alias("p"))).alias("speaks"))
    )
    speaking = materialise(speaking, "speaking")  # every directory meets the root's row: a hot key of a plain join
    parts = F.split("dir", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")),
    )
    tree = rows.select("dir").where("dir is not null").distinct().select("dir", F.explode(above).alias("up"))
    nearest = (
        tree.join(speaking.hint("merge"), F.col("up.dir") == F.col("from"))  # grows with the tree, as the next: never broadcast
        .groupBy(F.col("dir").alias("below"))
        .agg(F.max_by(F.struct("speaks", "from"), "up.depth").alias("near"))
    )
    nearest = materialise(nearest, "nearest")  # a row per directory; a plain join's hot keys are split
    joined = rows.join(nearest.hint("merge"), rows.dir == nearest.below, "left")
    added = ("inherited", "inherited_from", "effective")
    return joined.select(
        *[F.col("file").getField(c).alias(c) for c in files.columns if c not in added],
        F.col("near.speaks").alias("inherited"),
        F.col("near.from").alias("inherited_from"),
        F.coalesce("license", "near.speaks").alias("effective"),
    )


def scan(files: DataFrame, path: str = "path", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Own and inherited licences of all files; ``text`` is read once and not returned."""
    return inherit(materialise(with_license(files, text, threshold), "licences"), path)
