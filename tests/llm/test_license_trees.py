from __future__ import annotations

import re

import numpy as np
import pytest

from lodestone.llm import queries
from lodestone.llm.license_scan import TEMPLATES, Matcher
from tests.llm.documents import rows, table

TAGGED = [
    ("MIT", "// SPDX-License-Identifier: MIT"), ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"), (None, "SPDX-License-Identifier: Foo-1.0"),
]
SIBLINGS = [
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), ("CC-BY-3.0", "Licensed under CC BY 3.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."), ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"), (None, "Licensed under the Apache License, Version 1.1."), ("BSD-2-Clause", "BSD 2-Clause License"),
]


@pytest.mark.parametrize(("name", "text"), TAGGED + SIBLINGS)
def test_tags_and_siblings_are_told_apart(name, text):
    assert Matcher().scan(f"some prose\n\n{text}\n\nmore prose", 0.7)[0] == name


def dense(sentences):
    """Cosines of sentences to all templates by dense matrices, with nothing of the operator but its templates."""
    split = lambda x: re.findall(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*", x.lower())
    names = [n for n in sorted(TEMPLATES) for _ in TEMPLATES[n]]
    texts = [split(x) for n in sorted(TEMPLATES) for x in TEMPLATES[n]]
    words = sorted({t for x in [*texts, *map(split, sentences)] for t in x})
    at = {t: k for k, t in enumerate(words)}

    def counts(docs):
        out = np.zeros((len(docs), len(words)))
        for k, doc in enumerate(docs):
            np.add.at(out[k], [at[t] for t in doc], 1)
        return out

    x, y = counts([split(s) for s in sentences]), counts(texts)
    idf = np.log((1 + len(texts)) / (1 + (y > 0).sum(axis=0))) + 1
    unit = lambda m: m * idf / np.linalg.norm(m * idf, axis=1, keepdims=True)
    return names, unit(x) @ unit(y).T


def test_cosines_equal_dense_matrices():
    some = [x for n in sorted(TEMPLATES) for x in TEMPLATES[n][:2]] + ["Released under the MIT License by a friend", "Redistribution of software is permitted", "the public domain license"]
    names, cosines = dense(some)
    matcher = Matcher()
    for sentence, row in zip(some, cosines, strict=True):
        score, name = matcher.best(sentence)
        assert score == pytest.approx(row.max(), abs=1e-9)
        assert name in {names[k] for k in np.flatnonzero(row > row.max() - 1e-9)}


def test_the_query_inherits_at_every_depth(spark, tmp_path):
    data = [r for r in rows(n=300) if r[0] is not None]
    said = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "It has no license at all"]
    data = [(r[0], f"{r[1]}\n{said[k // 9 % 3]}" if k % 9 == 0 else r[1], r[2], r[3], *r[4:]) for k, r in enumerate(data)]
    table(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op1_license_scan(spark, str(tmp_path)).collect()
    assert len(found) == len(data)
    speaks = {}
    for r in sorted(found, key=lambda r: (-r.score, r.path)):
        folder, _, name = r.path.rpartition("/")
        if name.startswith("LICENSE-") and r.license:
            speaks.setdefault(folder, r.license)
    depths = set()
    for r in found:
        above = r.path.rpartition("/")[0]
        while above and above not in speaks:
            above = above.rpartition("/")[0]
        assert (r.inherited, r.inherited_from) == ((speaks[above], above) if above else (None, None))
        assert r.effective == (r.license or r.inherited)
        depths.add((r.inherited_from or "").count("/") if r.inherited else None)
    assert {0, 1, 2} <= depths
    assert {r.license for r in found} == {None, "MIT", "CC-BY-NC-4.0"}
