"""Licence recognition from known sentences and ordered rules.

A text is normalised (lower case, every run of characters other than letters and
digits one space) and cut into parts at line breaks, blank lines and sentence
ends; lines of comment marks alone count as blank.  A known sentence begins where
a part begins, goes on over any number of wrapped lines, though not over a blank
line or a sentence end, and ends where a part ends; of several the longest is
taken, and a list mark such as ``1.`` or ``(b)`` may stand before it.  A slot of a known
sentence holds one to eight words, such as the name of a holder.  A tag of markup ends a
part.  Known
sentences have identifiers, and those found, in order, make a sequence.  A rule
is an ordered list of identifiers; it matches where they occur in that order with
at most ``gap`` unknown parts between two of them.  A match gives way to a longer
one whose span holds it.

Everything is DataFrame expressions inside a row: no text is exploded or
shuffled.  The sentences are compiled into one pattern that branches word by word
and runs once over a text, so the work grows with the text; the pattern grows
with the caller's list.  Every known sentence holds one of a few key words; a text
without any of them holds no known sentence and is not normalised.

Defined results: null, empty and sentence-free texts give empty lists; a
sentence that occurs again is matched again; rules of equal sentences all match;
a rule with a sentence that is not known, and an empty list of rules, is an
error; repeated rows get equal rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.llm.session import id_and_text

#: Between parts: a line that may be wrapped, and the end of a sentence or a block.
LINE, STOP = "\n", "\x01"
#: In a known sentence: one to eight words of any kind, such as a name.
SLOT = "§"
#: How a sentence with a slot is found again once it holds words: what stands around them.
SLOTS: tuple[tuple[str, str], ...] = (("neither the name of ", " nor the names of its contributors may"), ("the name of ", " may not be used to endorse"), ("", " is free software you can redistribute it"))


def parts_of(text: str) -> list[str]:
    """The sentences of an unwrapped notice, normalised."""
    text = re.sub(r"(?<=[.!?])(?<!\sv\.)\s+|\n\s*\n", STOP, text.lower())
    return [s for s in (re.sub(rf"[^\w{SLOT}]+|_+", " ", part).strip() for part in text.split(STOP)) if s]


@dataclass(frozen=True)
class LicenceRule:
    """A licence and the ordered sentences that state it."""

    name: str
    licence: str
    sentences: tuple[str, ...]


def _granted(name: str) -> tuple[str, ...]:
    """Forms of a grant under a licence."""
    heads = ("Released under the", "Licensed under the", "Released under the terms of the", "Licensed under the terms of the", "This project is licensed under the terms of the", "Distributed under the")
    ends = ("", " see LICENSE", " see LICENSE for details", " see the LICENSE file", " see the LICENSE file for details")
    return tuple(f"{head} {name}{end}" for head in heads for end in ends)


#: One-line statements: identifier, licence, name of the rule, forms.
STATEMENTS: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("mit-grant", "MIT", "mit-short", _granted("MIT License") + ("This project is licensed under the MIT License",)),
    ("mit-title", "MIT", "mit-title", ("The MIT License", "The MIT License MIT")),
    ("apache-2-grant", "Apache-2.0", "apache-short", _granted("Apache License Version 2 0") + _granted("Apache License 2 0")),
    ("apache-2-title", "Apache-2.0", "apache-title", ("Apache License Version 2 0 January 2004",)),
    ("gpl-3-title", "GPL-3.0", "gpl-3-title", ("GNU General Public License Version 3 29 June 2007",)),
    ("gpl-2-title", "GPL-2.0", "gpl-2-title", ("GNU General Public License Version 2 June 1991",)),
    ("lgpl-3-title", "LGPL-3.0", "lgpl-3-title", ("GNU Lesser General Public License Version 3 29 June 2007",)),
    ("lgpl-2-title", "LGPL-2.1", "lgpl-2-title", ("GNU Lesser General Public License Version 2 1 February 1999",)),
    ("agpl-3-title", "AGPL-3.0", "agpl-3-title", ("GNU Affero General Public License Version 3 19 November 2007",)),
    ("gpl-3-grant", "GPL-3.0", "gpl-3-short", _granted("GNU General Public License version 3") + ("This work is licensed under the GNU General Public License version 3",)),
    ("gpl-2-grant", "GPL-2.0", "gpl-2-short", _granted("GNU General Public License version 2") + ("This work is licensed under the GNU General Public License version 2",)),
    ("bsd-2-grant", "BSD-2-Clause", "bsd-2-short", _granted("BSD 2 Clause License")),
    ("bsd-3-grant", "BSD-3-Clause", "bsd-3-short", _granted("BSD 3 Clause License")),
    ("isc-grant", "ISC", "isc-short", _granted("ISC License")),
    ("mpl-2-grant", "MPL-2.0", "mpl-2-short", _granted("Mozilla Public License Version 2 0")),
    *(
        (f"cc-{kind}-{v}-grant", f"CC-{kind.upper()}-{v}.0", f"cc-{kind}-short" if v == 4 else f"cc-{kind}-{v}-short", (
            f"Licensed under CC {kind} {v} 0", f"This work is licensed under CC {kind} {v} 0",
            *(f"This work is licensed under {a}Creative Commons {name} {v} 0{z}" for a in ("", "a ", "the ") for z in ("", " License", f" {where}", f" {where} License")),
        ))
        for v, where in ((4, "International"), (3, "Unported"))
        for kind, name in (("by", "Attribution"), ("by-sa", "Attribution ShareAlike"), ("by-nc", "Attribution NonCommercial"), ("by-nd", "Attribution NoDerivatives"), ("by-nc-sa", "Attribution NonCommercial ShareAlike"), ("by-nc-nd", "Attribution NonCommercial NoDerivatives"))
    ),
    ("cc0-grant", "CC0-1.0", "cc0-short", ("Licensed under CC0 1 0", "This work is licensed under CC0 1 0", "This work is dedicated to the public domain under CC0 1 0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work")),
    ("rights-reserved", "proprietary", "reserved", ("All rights reserved",)),
    ("public-domain", "public-domain", "public-domain", ("This work is in the public domain", "This file is in the public domain")),
)

#: Names of the identifier line of source files and the licence that each means.
SPDX: dict[str, str] = {
    "MIT": "MIT", "MIT-0": "MIT-0", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "0BSD": "0BSD", "ISC": "ISC", "Zlib": "Zlib",
    "MPL-2.0": "MPL-2.0", "EPL-2.0": "EPL-2.0", "BSL-1.0": "BSL-1.0", "Unlicense": "Unlicense", "CC0-1.0": "CC0-1.0", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0",
    **{f"{kind}-{v}{end}": f"{kind}-{v}" for kind, v in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")) for end in ("", "-only", "-or-later", "+")},
}

#: Names that are joined by OR and AND.
JOINED: tuple[str, ...] = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "MPL-2.0", "GPL-2.0-or-later", "GPL-3.0-or-later", "Unlicense", "CC0-1.0")

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_LIABLE = """IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_BSD_LIABLE = """IN NO EVENT SHALL THE COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = "Permission to use, copy, modify, {} distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License."""
_APACHE_END = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_GNU_FORMS = (
    "the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.",
    "the {name} as published by the Free Software Foundation, version {v} of the License.",
    "the {name} version {v} as published by the Free Software Foundation.",
    "version {v} of the {name} as published by the Free Software Foundation.",
)

#: Notices by rule name: the licence and alternatives for each of their stretches, in order.
NOTICES: dict[str, tuple[str, tuple[tuple[str, ...], ...]]] = {
    "mit-core": ("MIT", ((_MIT + ", subject to the following conditions:",),)),
    "mit-full": ("MIT", (
        (_MIT + ", subject to the following conditions:",),
        ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."),
        (_AS_IS,),
    )),
    "mit-0": ("MIT-0", ((_MIT + ".",), (_AS_IS,))),
    "bsd-2": ("BSD-2-Clause", ((_BSD,),)),
    "bsd-3": ("BSD-3-Clause", ((_BSD,), (_BSD_NAME.format(SLOT), f"The name of {SLOT} may not be used to endorse or promote products derived from this software without specific prior written permission."))),
    "isc": ("ISC", (tuple(_ISC.format(join) + ", provided that the above copyright notice and this permission notice appear in all copies." for join in ("and/or", "and")),)),
    "isc-full": ("ISC", (tuple(_ISC.format(join) + ", provided that the above copyright notice and this permission notice appear in all copies." for join in ("and/or", "and")), (_ISC_AS_IS,))),
    "0bsd": ("0BSD", (tuple(_ISC.format(join) + "." for join in ("and/or", "and")), (_ISC_AS_IS,))),
    "apache-core": ("Apache-2.0", ((_APACHE,),)),
    "apache-notice": ("Apache-2.0", ((_APACHE,), ("You may obtain a copy of the License at",), ("http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"))),
    "apache-one-line": ("Apache-2.0", ((_APACHE,), ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"))),
    "apache-header": ("Apache-2.0", (("Licensed under the Apache License, Version 2.0",), ("you may not use this file except in compliance with the License.",), ("You may obtain a copy of the License at",))),
    **{
        f"{kind.lower()}-{v}-{i}": (f"{kind}-{v}", ((f"{SLOT} is free software: you can redistribute it and/or modify it under the terms of " + form.format(name=_GNU[kind], v=v.removesuffix(".0")),),))
        for kind, v in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")) for i, form in enumerate(_GNU_FORMS)
    },
    "mpl-2": ("MPL-2.0", (("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, Version 2.0."),)),
    "epl-2": ("EPL-2.0", (("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at"),)),
    "bsl-1": ("BSL-1.0", (("Distributed under the Boost Software License, Version 1.0.",),)),
    "unlicense": ("Unlicense", (("This is free and unencumbered software released into the public domain.",),)),
    "zlib": ("Zlib", (("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),)),
}

#: Sentences that stand with notices and state no licence by themselves.
EXTRAS: tuple[str, ...] = (_LIABLE, _BSD_AS_IS, _BSD_LIABLE.format("HOLDER"), _BSD_LIABLE.format("HOLDERS"), _BSD_LIABLE.format("OWNER"), _APACHE_END)


def _notice_rules() -> tuple[dict[str, str], list[LicenceRule]]:
    """Known sentences (sentence to identifier) and rules of STATEMENTS, SPDX, NOTICES and EXTRAS."""
    ids: dict[str, str] = {}
    rules = []
    for name, licence, rule, forms in STATEMENTS:
        for form in forms:
            ids[" ".join(parts_of(form))] = name
        rules.append(LicenceRule(rule, licence, (name,)))
    for tag, licence in SPDX.items():
        name = f"spdx-{tag.lower()}"
        ids.setdefault(f"spdx license identifier {' '.join(parts_of(tag))}", name)
        rules.append(LicenceRule(name, licence, (ids[f"spdx license identifier {' '.join(parts_of(tag))}"],)))
    for a, b in permutations(JOINED, 2):
        for join in ("or", "and"):
            name = f"spdx-{a.lower()}-{join}-{b.lower()}"
            ids[f"spdx license identifier {parts_of(a)[0]} {join} {parts_of(b)[0]}"] = name
            rules += [LicenceRule(name, SPDX[tag], (name,)) for tag in (a, b)]
    for name, (licence, stretches) in NOTICES.items():
        sequences: list[tuple[str, ...]] = [()]
        for i, alternatives in enumerate(stretches):
            named = [tuple(ids.setdefault(s, f"{name}/{i}.{j}.{k}") for k, s in enumerate(parts_of(text))) for j, text in enumerate(alternatives)]
            sequences = [s + more for s in sequences for more in dict.fromkeys(named)]
        rules += [LicenceRule(name, licence, s) for s in sequences]
    for i, text in enumerate(EXTRAS):
        for k, s in enumerate(parts_of(text)):
            ids.setdefault(s, f"extra/{i}.{k}")
    return ids, list(dict.fromkeys(rules))


SENTENCES, _RULES = _notice_rules()
RULES: tuple[LicenceRule, ...] = tuple(_RULES)

#: Parts of words of which every known sentence should hold one; a sentence without any adds its longest word.
KEYS: tuple[str, ...] = ("licen", "permission", "redistribution", "warrant", "rights", "domain", "software", "liab", "copyright")


def keys_of(known: Iterable[str], keys: Sequence[str] = KEYS) -> list[str]:
    """The key words that the sentences need, so that each of them holds one."""
    own = [max((w for w in s.split(" ") if w != SLOT), key=len) for s in known if not any(k in s for k in keys)]
    return sorted({*(k for k in keys if any(k in s for s in known)), *own})


#: What a slot may hold: words, over wrapped lines.
_ANY = rf"[\p{{L}}\p{{N}}]+(?:[ {LINE}][\p{{L}}\p{{N}}]+){{0,7}}?"


def pattern_of(known: Iterable[str]) -> str:
    """A pattern, branching word by word, whose matches are the parts of a normalised text; its group is a known sentence."""
    tree: dict = {}
    for sentence in known:
        node = tree
        for word in sentence.split(" "):
            node = node.setdefault(word, {})
        node[""] = {}

    def branch(node: dict) -> str:
        """What may follow a word, the longer before the shorter."""
        words = sorted((w for w in node if w), key=lambda w: (w == SLOT, w))
        ways = [(_ANY if w == SLOT else re.escape(w)) + branch(node[w]) for w in words]
        if not ways:
            return ""
        one = f"[ {LINE}]" + ways[0] if len(ways) == 1 else f"[ {LINE}](?:{'|'.join(ways)})"
        return f"(?:{one})?" if "" in node else one

    heads = "|".join((_ANY if w == SLOT else re.escape(w)) + branch(tree[w]) for w in sorted(tree, key=lambda w: (w == SLOT, w)))
    return rf"(?:[\p{{L}}\p{{N}}]{{1,2}} )?({heads})(?=[{LINE}{STOP}]|\z)|[^{LINE}{STOP}]+"


def normalised(low: Column) -> Column:
    """Letters and digits of a lower-case text, LINE between lines, STOP between sentences and blocks."""
    out = F.regexp_replace(low, r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>", STOP)
    out = F.regexp_replace(out, r"(?<=[.!?])(?<!\s(?:v|inc|corp|co|ltd)\.)[\x20\x09-\x0D]+", STOP)
    out = F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}{LINE}{STOP}]+", " ")
    out = F.regexp_replace(out, rf" *{LINE} *", LINE)
    return F.regexp_replace(out, rf"[ {LINE}]*{STOP}[ {LINE}{STOP}]*|{LINE}{LINE}+", STOP)


def parts(low: Column, known: Mapping[str, str]) -> Column:
    """The parts of a lower-case text in order: the known sentence, or an empty string."""
    found = F.regexp_extract_all(F.trim(normalised(low)), F.lit(pattern_of(known)), 1)

    def plain(part: Column) -> Column:
        out = F.translate(part, LINE, " ")
        for before, after in SLOTS:
            out = F.regexp_replace(out, f"^{before}.+?{after}", f"{before}{SLOT}{after}")
        return out

    return F.transform(found, plain)


def scan(docs: DataFrame, known: Mapping[str, str] = SENTENCES, rules: Sequence[LicenceRule] = RULES, gap: int = 2) -> DataFrame:
    """doc_id, the identifier sequence, the rule matches and the licences of every document.

    ``known`` maps normalised sentences to identifiers.  A match is (rule, licence, first, last): the places of
    its first and last sentence among the parts of the text.
    """
    unknown = {name for rule in rules for name in rule.sentences} - set(known.values())
    if unknown:
        raise ValueError(f"rules name unknown sentences: {sorted(unknown)}")
    if not rules:
        raise ValueError("no rules")
    relevant = F.lit(False)
    for key in keys_of(known):
        relevant = relevant | F.col("low").contains(key)
    book = F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*map(F.lit, known.values())))
    listed = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.licence).alias("licence"), F.array(*map(F.lit, r.sentences)).alias("s")) for r in rules))

    def next_one(at: Column, name: Column) -> Column:
        near = F.slice("ids", at["n"] + 1, F.lit(gap + 1))
        return F.get(F.filter(near, lambda y: (y["id"] == name) & (y["at"] <= at["at"] + gap + 1)), F.lit(0))

    def matches(rule: Column) -> Column:
        begun = F.filter("ids", lambda x: x["id"] == rule["s"][0])
        ended = F.transform(begun, lambda x: F.struct(x.alias("a"), F.aggregate(F.slice(rule["s"], 2, F.greatest(F.size(rule["s"]), F.lit(1))), x, next_one).alias("z")))
        return F.transform(F.filter(ended, lambda m: m["z"].isNotNull()), lambda m: F.struct(rule["rule"].alias("rule"), rule["licence"].alias("licence"), m["a"]["at"].alias("first"), m["z"]["at"].alias("last")))

    places = F.filter(F.transform("p", lambda p, i: F.struct(p.alias("s"), i.alias("at"))), lambda x: x["s"] != "")
    ids = F.transform(places, lambda x, i: F.struct(F.try_element_at(book, x["s"]).alias("id"), x["at"].alias("at"), (i + 1).alias("n")))
    started = F.filter(listed, lambda r: F.array_contains(F.transform("ids", lambda x: x["id"]), r["s"][0]))

    def inside(m: Column) -> Column:
        return F.exists("wide", lambda o: (o["first"] <= m["first"]) & (o["last"] >= m["last"]) & (o["last"] - o["first"] > m["last"] - m["first"]))

    none = F.array().cast("array<string>")
    return (
        id_and_text(docs).select("doc_id", F.lower("text").alias("low"))
        .select("doc_id", F.coalesce(F.when(relevant, parts(F.col("low"), known)), none).alias("p"))
        .select("doc_id", ids.alias("ids"))
        .select("doc_id", "ids", F.flatten(F.transform(started, matches)).alias("every"))
        .select("doc_id", "ids", "every", F.filter("every", lambda m: m["last"] > m["first"]).alias("wide"))
        .select("doc_id", "ids", F.filter("every", lambda m: ~inside(m)).alias("matches"))
        .select("doc_id", F.transform("ids", lambda x: x["id"]).alias("sequence"), "matches", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))).alias("licences"))
    )


def report(docs: DataFrame, **options) -> DataFrame:
    """One flat row per document: the sequence and the licences joined by commas, and the number of matches."""
    return scan(docs, **options).select(
        "doc_id", F.array_join("sequence", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"),
        F.size("matches").cast("long").alias("n_matches"), F.array_join(F.transform("matches", lambda m: F.concat_ws("@", m["rule"], m["first"].cast("string"))), ",").alias("rules"),
    )
