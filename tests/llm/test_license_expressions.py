"""Expressions, dual grants, more licences, and the runner-up of the best sentence."""

import pytest

from lodestone.llm.license_scan import Matcher, alternatives, with_license

MATCHER = Matcher()
SEVERAL = [
    (["Apache-2.0", "MIT"], "// SPDX-License-Identifier: MIT OR Apache-2.0"),
    (["Apache-2.0", "BSD-3-Clause", "MIT"], "/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */"),
    (["GPL-2.0"], "# SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note"),
    (["LGPL-2.1"], "SPDX-License-Identifier: LGPL-2.1+"),
    (["MIT"], "SPDX-License-Identifier: MIT OR Foo-1.0"),
    (["Apache-2.0", "MIT"], "Licensed under either of Apache License, Version 2.0 or MIT license"),
    (["Apache-2.0", "MIT"], "This crate is dual-licensed under the Apache License, Version 2.0 and the MIT License."),
    (["MPL-2.0"], "SPDX-License-Identifier: MPL-2.0"),
]
MORE = [
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."), ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"), ("Artistic-2.0", "Licensed under the Artistic License 2.0."),
    ("EPL-1.0", "Eclipse Public License - v 1.0"), ("EUPL-1.2", "Licensed under the EUPL, Version 1.2"), ("PSF-2.0", "SPDX-License-Identifier: PSF-2.0"), ("MIT-0", "MIT No Attribution"), ("MIT", "MIT License"),
]


@pytest.mark.parametrize(("names", "text"), SEVERAL)
def test_all_licences_of_a_sentence(names, text):
    license_, score, licenses, _, _ = MATCHER.scan_all(f"prose before\n\n{text}\n\nprose after", 0.7)
    assert licenses == names and license_ in names and score >= 0.7


@pytest.mark.parametrize(("name", "text"), MORE)
def test_more_licences(name, text):
    assert MATCHER.scan(text, 0.7)[0] == name


@pytest.mark.parametrize("text", ["Licensed under the same license or another.", "You may be licensed under the license and its terms", "It is sold as-is or not at all", "SPDX-License-Identifier: OR WITH"])
def test_what_names_no_licence(text):
    assert MATCHER.scan_all(text, 0.7) == (None, 0.0, [], None, 0.0)


def test_an_expression_ends_where_its_grammar_does():
    assert alternatives("SPDX-License-Identifier: MIT OR Apache-2.0 see below for ISC") == ["SPDX-License-Identifier: MIT", "SPDX-License-Identifier: Apache-2.0"]
    assert alternatives("SPDX-License-Identifier: MIT") == [] and alternatives("no grant") == []


def test_columns_and_runner_up(spark):
    rows = [(1, "Licensed under the MIT License.", "kept"), (2, None, "x"), (3, "", "x"), (4, "SPDX-License-Identifier: MIT OR ISC", "x")]
    found = {r.id: r for r in with_license(spark.createDataFrame(rows, "id int, text string, margin string")).collect()}
    assert found[1].license == "MIT" and found[1].runner_up != "MIT" and 0 < found[1].margin <= found[1].score
    assert found[2][1:] == found[3][1:] == (None, 0.0, [], None, 0.0)
    assert found[4].licenses == ["ISC", "MIT"] and found[4].license == "MIT"
