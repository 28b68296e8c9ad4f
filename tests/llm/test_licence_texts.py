"""Licence files, file headers and SPDX tags in their usual wording."""

from __future__ import annotations

import pytest

from siftwall.llm import licenses

MIT = """The software is provided to you by its author.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
ISC = """Copyright 2020 An Author

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"""
BSD = """Copyright (c) 2020, An Author. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE"""
THIRD = """* Neither the name of Example Ltd. nor the names of its contributors may be
  used to endorse or promote products derived from this software without
  specific prior written permission.
"""
GNU = """# This file is part of Example.
#
# Example is free software: you can redistribute it and/or modify
# it under the terms of the GNU {}General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
#
# Example is distributed in the hope that it will be useful,
import os
"""
FILES = [
    ("MIT", MIT),
    ("MIT", " ".join(MIT.split())),
    ("ISC", ISC),
    ("BSD-2-Clause", BSD % ""),
    ("BSD-3-Clause", BSD % THIRD),
    ("GPL-2.0", GNU.format("", "2")),
    ("GPL-3.0", GNU.format("", "3")),
    ("AGPL-3.0", GNU.format("Affero ", "3")),
    ("LGPL-2.1", GNU.format("Lesser ", "2.1")),
    (
        "MPL-2.0",
        "/* This Source Code Form is subject to the terms of the Mozilla Public\n"
        " * License, v. 2.0. If a copy of the MPL was not distributed with this\n"
        " * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\nint x;",
    ),
    (
        "GPL-3.0",
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n"
        " Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n"
        " Everyone is permitted to copy and distribute verbatim copies\n"
        " of this license document, but changing it is not allowed.\n\n                            Preamble\n",
    ),
    (
        "Apache-2.0",
        "                                 Apache License\n                           Version 2.0, January 2004\n"
        "                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION,"
        " AND DISTRIBUTION\n\n   1. Definitions.\n",
    ),
    ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\nx"),
    ("MIT", "x\n<!-- SPDX-License-Identifier: MIT -->"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "# SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0+ */"),
    ("MIT", "SPDX-License-Identifier: (Zlib OR MIT)"),
    (None, "SPDX-License-Identifier: EPL-2.0"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, t) for k, (_, t) in enumerate(FILES)]
    docs = spark.createDataFrame(rows, "k int, text string").selectExpr("k", "'x' AS path", "text")
    return {r.k: r.own and r.own.licence for r in licenses.own_licences(docs).collect()}


@pytest.mark.parametrize("k", range(len(FILES)))
def test_licence_of(found, k):
    assert found[k] == FILES[k][0]
