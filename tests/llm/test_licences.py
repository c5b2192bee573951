"""Licences on full texts (licence_texts, each named for its licence) and on standard headers."""

from pathlib import Path

from tidemark.llm import licences

APACHE = '''/*
 * Copyright 2020 Some One
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
'''
GNU = '''# This {what} is free software; you can redistribute it and/or modify
# it under the terms of the GNU {name} as published by
# the Free Software Foundation; either version {version} of the License, or
# (at your option) any later version.
'''
HEADERS = [
    (APACHE, ["Apache-2.0"]),
    (GNU.format(what="program", name="General Public License", version="2"), ["GPL-2.0"]),
    (GNU.format(what="program", name="General Public License", version="3"), ["GPL-3.0"]),
    (GNU.format(what="library", name="Lesser General Public\n# License", version="2.1"), ["LGPL-2.1"]),
    (GNU.format(what="program", name="Affero General Public License", version="3"), ["AGPL-3.0"]),
    ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */", ["MPL-2.0"]),
    ("// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.", ["BSD"]),
    ("// SPDX-License-Identifier: LGPL-2.1-or-later\nint x;", ["LGPL-2.1"]),
    ("This project is licensed under the MIT License - see the LICENSE file for details.", ["MIT"]),
    ("Licensed under either the MIT license or the Apache License, Version 2.0", ["Apache-2.0", "MIT"]),
    ("This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
    ("Copyright 2020 Foo. All rights reserved.", ["Proprietary"]),
    ("It is not licensed under the MIT License, and a licence is needed.", []),
    (None, []),
]


def test_full_texts(spark):
    files = sorted((Path(__file__).parent / "licence_texts").iterdir())
    rows = spark.createDataFrame([(p.stem, p.read_text()) for p in files], "doc_id string, text string")
    assert {r.doc_id: r.licences for r in licences.scan(rows).collect()} == {p.stem: [p.stem] for p in files}


def test_headers(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HEADERS)], "doc_id long, text string")
    assert [r.licences for r in licences.scan(rows).orderBy("doc_id").collect()] == [want for _, want in HEADERS]
