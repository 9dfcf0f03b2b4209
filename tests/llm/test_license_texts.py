from __future__ import annotations

import textwrap

import pytest

from lodestone.llm.license_scan import Matcher

GNU = "{} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
HEADERS = [
    ("GPL-2.0", GNU.format("This program", ";", "General", ";", "2")),
    ("GPL-3.0", GNU.format("This program", ":", "General", ",", "3")),
    ("GPL-3.0", GNU.format("Foo", ":", "General", ",", "3")),
    ("LGPL-2.1", GNU.format("This library", ";", "Lesser General", ";", "2.1")),
    ("LGPL-3.0", GNU.format("This library", ":", "Lesser General", ",", "3")),
    ("AGPL-3.0", GNU.format("This program", ":", "Affero General", ",", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("BSD-3-Clause", "\n\n".join(BSD)),
    ("BSD-2-Clause", "\n\n".join(BSD[:3])),
    ("BSD-2-Clause", "\n".join(BSD[:3])),
]
FILES = [
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>"),
    ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,"),
    ("LGPL-2.1", "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n"),
    ("LGPL-3.0", "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n"),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions"),
    ("MIT", "MIT License\n\nCopyright (c) 2024 Someone\n"),
    ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2024, Someone\n\n" + "\n\n".join(textwrap.fill(x, 78) for x in BSD[:3])),
    ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2024, Someone\n\n" + "\n\n".join(textwrap.fill(x, 78) for x in BSD)),
]


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * "])
@pytest.mark.parametrize("width", [60, 76, 10_000])
def test_headers_are_told_apart_however_they_are_wrapped(width, mark):
    matcher = Matcher()
    for name, text in HEADERS:
        wrapped = "\n".join(mark + x for line in text.split("\n") for x in textwrap.wrap(line, width) or [""])
        assert matcher.scan(f"{mark}Copyright 2024 Someone\n{mark}\n{wrapped}\n{mark}\ncode = 1\n", 0.7)[0] == name


def test_openings_of_licence_files():
    matcher = Matcher()
    assert [(matcher.scan(text, 0.7)[0]) for _, text in FILES] == [name for name, _ in FILES]


def test_prose_is_no_licence():
    matcher = Matcher()
    for text in ("The driver had a licence.\nIt was in the public domain\nof the city, she said.", "Redistribution of wealth\nis a public matter.", "The general public needs no license\nto fish here."):
        assert matcher.scan(text, 0.7) == (None, 0.0)
