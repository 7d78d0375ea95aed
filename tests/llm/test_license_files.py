"""Whole standard licence files and headers, as they stand in projects."""

import textwrap

import pytest

MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.
"""
BSD_HEAD = """Copyright (c) 2015, Example Corp.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
APACHE = """Copyright 2019 The Authors. All Rights Reserved.

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL = """This file is part of Example.

Example Tools is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

Example Tools is distributed in the hope that it will be useful.
"""
ISC = """ISC License
Copyright 2021 Jane Doe
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
FILES = {
    "MIT": MIT, "BSD-3-Clause": BSD_HEAD + BSD_NAMES + BSD_TAIL, "BSD-2-Clause": BSD_HEAD + BSD_TAIL, "Apache-2.0": APACHE,
    "GPL-3.0-or-later": GPL, "ISC": ISC,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not\ndistributed.",
}


def test_whole_license_texts(docs_of):
    from tallyspark.llm.license_scan import scan_licenses
    forms = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: textwrap.indent(t, "# ", lambda _: True) + "\nimport os\n",
             lambda t: "/*\n" + textwrap.indent(t, " * ", lambda _: True) + " */\nint x;\n"]
    pairs = [(i * 10 + k, form(t)) for i, t in enumerate(FILES.values()) for k, form in enumerate(forms)]
    got = {(r.doc_id, r.license) for r in scan_licenses(docs_of(pairs)).collect()}
    assert got == {(i * 10 + k, name) for i, name in enumerate(FILES) for k in range(len(forms))}


def test_reserved_and_unknown_sentences(docs_of):
    from tallyspark.llm.license_scan import scan_licenses
    pairs = [(1, "Copyright 2020 X\nAll rights reserved.\n"), (2, "The code is not released under the MIT License."),
             (3, "2) Released under the MIT License\n"), (4, "SPDX-License-Identifier: Apache-2.0"), (5, "// " * 5000 + "\n" * 5000)]
    got = {(r.doc_id, r.license) for r in scan_licenses(docs_of(pairs)).collect()}
    assert got == {(1, "proprietary"), (3, "MIT"), (4, "Apache-2.0")}


@pytest.mark.parametrize("name,want", [("Apache-2.0", "Apache-2.0"), ("BSD", "BSD-3-Clause"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"),
                                       ("LGPL-3", "LGPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_license_files_of_the_system(docs_of, name, want):
    from pathlib import Path

    from tallyspark.llm.license_scan import scan_licenses
    path = Path("/usr/share/common-licenses", name)
    if not path.exists():
        pytest.skip("no such file here")
    assert {r.license for r in scan_licenses(docs_of([(1, path.read_text())])).collect()} == {want}


def test_rules_against_brute_force(spark):
    """Random sequences of identifiers, with repeats: a rule is met where its sentences stand in its order, and takes them all."""
    import random

    from pyspark.sql import functions as F
    from tallyspark.llm.license_scan import match_rules
    rng = random.Random(6)
    rules = [("R1", ["a", "b", "c"]), ("R2", ["b", "a"]), ("R1", ["c"]), ("R3", ["d", "e"]), ("R4", ["a"])]

    def brute(ids):
        names = []
        for name, needed in rules:
            left = iter(ids)
            if all(x in left for x in needed):  # one after the other
                ids = [x for x in ids if x not in needed]
                names += [name] * (name not in names)
        return names

    pairs = [(i, [rng.choice("abcdef") for _ in range(rng.randint(1, 12))]) for i in range(300)]
    got = spark.createDataFrame(pairs, "i int, ids array<string>").select("i", match_rules(F.col("ids"), rules).alias("names")).collect()
    assert {r.i: r.names for r in got} == {i: brute(ids) for i, ids in pairs}


def test_very_many_sentences(docs_of):
    """Time is linear: repeated lines, and lines that take turns."""
    import time

    from tallyspark.llm.license_scan import scan_licenses
    docs = docs_of([(1, "All rights reserved.\n" * 100_000), (2, "All rights reserved.\nReleased under the MIT License.\n" * 50_000)])
    at = time.time()
    assert {(r.doc_id, r.license, r.n_sentences) for r in scan_licenses(docs).collect()} == {(1, "proprietary", 100_000), (2, "MIT", 100_000)}
    assert time.time() - at < 120
