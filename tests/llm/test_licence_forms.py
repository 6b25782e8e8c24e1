"""Notices as they stand in the wild: names in slots, titles, identifiers joined by OR and AND, markup, wrapped and commented lines."""

from __future__ import annotations

import pytest

from loreforge.llm import licences

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""

CASES = [
    ("BSD-3-Clause", BSD + "\n\nNeither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", BSD + "\n\nNeither the name of the\ncopyright holder nor the names of its contributors may be used to endorse or promote\nproducts derived from this software without specific prior written permission."),
    ("BSD-3-Clause", BSD + "\n\n3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", BSD),
    ("GPL-3.0","Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0"," * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version."),
    ("MIT","This project is licensed under the terms of the MIT license."),
    ("MIT","Released under the MIT license, see LICENSE."),
    ("Apache-2.0,MIT","// SPDX-License-Identifier: MIT OR Apache-2.0"),
    ("MIT","<p>Released under the MIT License.</p>"),
    ("CC-BY-3.0","This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("Apache-2.0","                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n"),
    ("GPL-3.0","                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007"),
    ("MIT","The MIT License (MIT)\n\nCopyright (c) 2020 X"),
    ("","We like free software you can redistribute it"),
    ("","The name of the game is software.")]


def commented(text: str) -> str:
    return "\n".join(f" * {line}" for line in text.split("\n"))


@pytest.mark.parametrize("form", [str, commented])
def test_forms(spark, form):
    rows = spark.createDataFrame([(i, form(text)) for i, (_, text) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.report(rows).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for want, _ in CASES]


def test_wrapped_anywhere(spark):
    """A notice of one sentence, broken at every word."""
    words = CASES[4][1].split(" ")
    texts = [" ".join(words[:i]) + "\n" + " ".join(words[i:]) for i in range(1, len(words))]
    got = licences.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.licences for r in got} == {"GPL-3.0"} and len(got) == len(texts)
