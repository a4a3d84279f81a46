"""License scans by template-markup matching (operator 5).

A template is license wording in markup: plain words are mandatory, ``<<opt>> ... <<end>>`` is a region
that may be absent, and ``<<var 12>>`` stands for up to 12 words of any kind.  Each template compiles to
an automaton over tokens; a text is accepted where the mandatory words stand exactly and in order, with
any choice of its regions.  The automaton's states are bits of one integer, so a step is a few shifts,
and it starts only where the template's first words stand.  Texts without an anchor word are not run; the
anchors follow from the templates: a few words of which every template and phrase needs one at least.
Short licenses stand here with their whole bodies, long ones (Apache, GPL, MPL) with the notices by which
files name them; ``find`` takes other templates as well.

Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased.

Defined cases: a null or empty text has no words and score 0; repeated rows are scanned one by one;
texts are scanned whole; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .text_kernels import Words, buffers, slices, tidy

#: Phrases whose consecutive words name a license.
PHRASES = {
    "mit": "mit license",
    "apache": "apache license",
    "gpl": "general public license",
}
_COPYRIGHT = "<<opt>> copyright <<opt>> c <<end>> <<var 20>> <<opt>> all rights reserved <<end>> <<end>>"
_GNU = "gnu <<opt>> lesser <<end>> <<opt>> affero <<end>> general public license"
_BSD_BEGIN = f"""{_COPYRIGHT} redistribution and use in source and binary forms with or without modification are permitted
    provided that the following conditions are met <<opt>> 1 <<end>> redistributions of source code must retain the above
    copyright notice this list of conditions and the following disclaimer <<opt>> 2 <<end>> redistributions in binary form must
    reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
    materials provided with the distribution"""
_BSD_END = """this software is provided by <<var 10>> as is and any express or implied warranties including but not limited to
    the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 10>> be
    liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement
    of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of
    liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of
    this software even if advised of the possibility of such damage"""
#: Templates, in the markup above (the wording is fixed by the licenses).
TEMPLATES = {
    "mit-body": f"""<<opt>> mit license <<end>> {_COPYRIGHT} permission is hereby granted free of charge to any person obtaining a copy
        of this software and associated documentation files <<opt>> the software <<end>> to deal in the software without
        restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
        copies of the software and to permit persons to whom the software is furnished to do so subject to the following
        conditions the above copyright notice and this permission notice <<opt>> including the next paragraph <<end>> shall be
        included in all copies or substantial portions of the software the software is provided as is without warranty of any kind
        express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and
        noninfringement in no event shall <<var 8>> be liable for any claim damages or other liability whether in an action of
        contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the
        software""",
    "mit-grant": """permission is hereby granted free of charge to any person obtaining a copy of this software and
        associated documentation files <<opt>> the software <<end>> to deal in the software without restriction including
        without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
        and to permit persons to whom the software is furnished to do so subject to the following conditions""",
    "mit-named": """<<opt>> released <<end>> <<opt>> licensed <<end>> under the <<opt>> terms of the <<end>> mit license""",
    "isc-body": """permission to use copy modify and <<opt>> or <<end>> distribute this software for any purpose with or without fee
        is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is
        provided as is and <<var 6>> disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness in no event shall <<var 6>> be liable for any special direct indirect or consequential damages
        or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other
        tortious action arising out of or in connection with the use or performance of this software""",
    "bsd-2-clause": f"{_BSD_BEGIN} {_BSD_END}",
    "bsd-3-clause": f"""{_BSD_BEGIN} <<opt>> 3 <<end>> neither the name of <<var 12>> nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission {_BSD_END}""",
    "zlib-body": """this software is provided as is without any express or implied warranty in no event will the <<var 4>> be held
        liable for any damages arising from the use of this software permission is granted to anyone to use this software for any
        purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
        1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you
        use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2
        altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3
        this notice may not be removed or altered from any source distribution""",
    "boost-body": """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit
        the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished
        to do so all subject to the following""",
    "apache-2-notice": """licensed under the apache license version 2 0 the license you may not use this file except in compliance
        with the license you may obtain a copy of the license at <<var 12>> unless required by applicable law or agreed to in
        writing software distributed under the license is distributed on an as is basis without warranties or conditions of any
        kind either express or implied see the license for the specific language governing permissions and limitations under the
        license""",
    "apache-2-named": """licensed under the apache license <<opt>> version <<end>> 2 0""",
    "gnu-notice": f"""is free software you can redistribute it and or modify it under the terms of the {_GNU} as published by the free
        software foundation either version <<var 2>> of the license or <<opt>> at your option <<end>> any later version <<var 6>> is
        distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the {_GNU} for more details <<opt>> you should have received a copy
        of the {_GNU} along with this program <<end>>""",
    "gnu-named": f"""licensed under the {_GNU}""",
    "cc-by-named": """licensed under <<opt>> a <<end>> <<opt>> the <<end>> <<opt>> creative commons <<end>> cc by""",
    "mpl-2-notice": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at <<opt>> http <<end>> <<opt>> https <<end>> <<opt>> www <<end>> mozilla org
        mpl 2 0""",
    "unlicense-body": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish
        use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial
        or non commercial and by any means""",
}
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[0x30:0x3A] = _SEPARATOR[0x41:0x5B] = _SEPARATOR[0x61:0x7B] = False
_SEPARATOR[0x80:] = False
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Automaton:
    """States 0..n are places between tokens; bit i of a set means that state i is active."""

    first: frozenset[bytes]
    on_word: dict[bytes, int]  # word -> the states that it moves on
    on_any: int  # the states that any word moves on
    skips: tuple[tuple[int, int], ...]  # (from, to) without a word, ascending
    accept: int
    mandatory: int

    def closed(self, states: int) -> int:
        for a, b in self.skips:
            if states >> a & 1:
                states |= 1 << b
        return states

    def match(self, words: list[bytes], at: int) -> tuple[int, int]:
        """(end of the longest match or -1, furthest state reached)."""
        states, end, furthest = self.closed(1), -1, 0
        if states >> self.accept & 1:
            end = at
        for i in range(at, len(words)):
            states = ((states & self.on_word.get(words[i], 0)) | (states & self.on_any)) << 1
            if not states:
                break
            states = self.closed(states)
            furthest = max(furthest, states.bit_length() - 1)
            if states >> self.accept & 1:
                end = i + 1
        return end, furthest


def compiled(markup: str) -> Automaton:
    """The automaton of a template."""
    on_word: dict[bytes, int] = {}
    skips, opened, state, on_any, mandatory = [], [], 0, 0, 0
    for token in re.findall(r"<<[^>]*>>|[^\s<>]+", markup):
        if token == "<<opt>>":
            opened.append(state)
        elif token == "<<end>>":
            skips.append((opened.pop(), state))
        elif token.startswith("<<var"):
            most = int(token[5:-2])
            for j in range(most):
                on_any |= 1 << (state + j)
                skips.append((state + j, state + most))
            state += most
        else:
            word = token.lower().encode()
            on_word[word] = on_word.get(word, 0) | 1 << state
            mandatory += not opened
            state += 1
    if opened:
        raise ValueError("a region is not closed")
    # skips are followed in order of their starts; a jump over a region can land on the start of the next
    skips.sort()
    draft = Automaton(frozenset(), on_word, on_any, tuple(skips), state, mandatory)
    start = draft.closed(1)
    if start >> state & 1 or start & on_any:
        raise ValueError("a template must begin with mandatory or optional words")
    first = frozenset(w for w, places in on_word.items() if places & start)
    return Automaton(first, on_word, on_any, tuple(skips), state, mandatory)


_phrase = {label: tuple(p.encode().split()) for label, p in PHRASES.items()}


def mandatory_words(markup: str) -> set[str]:
    """The words that every text of a template holds."""
    depth, out = 0, set()
    for token in re.findall(r"<<[^>]*>>|[^\s<>]+", markup):
        depth += (token == "<<opt>>") - (token == "<<end>>")
        if not depth and not token.startswith("<<"):
            out.add(token.lower())
    return out


def anchors(markups: Iterable[str]) -> re.Pattern[bytes]:
    """A pattern that every text of one of the templates holds: words taken in turn that most of the templates
    left need, long ones if they can, as short words stand in every text."""
    left = [mandatory_words(m) for m in markups]
    left = [{w for w in words if len(w) >= 6} or {max(words, key=lambda w: (len(w), w))} for words in left]
    found = []
    while left:
        need = Counter(w for words in left for w in words)
        best = max(need, key=lambda w: (need[w], len(w), w))
        found.append(best)
        left = [words for words in left if best not in words]
    return re.compile(b"|".join(re.escape(w.encode()) for w in found))


@dataclass(frozen=True)
class Library:
    """Compiled templates and their anchors."""

    automata: tuple[tuple[str, Automaton], ...]
    anchors: re.Pattern[bytes]


@lru_cache(maxsize=8)
def library(templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES.items())) -> Library:
    return Library(tuple((name, compiled(markup)) for name, markup in templates), anchors([*PHRASES.values(), *(m for _, m in templates)]))


def scan(words: list[bytes], known: Library | None = None) -> tuple[list[tuple[str, int]], list[tuple[str, int, int]], float]:
    """((label, start) of phrases, (template, start, end) of accepted places, score)."""
    phrases, accepted, score = [], [], 0.0
    starts: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        starts.setdefault(w, []).append(i)
    for label, p in _phrase.items():
        phrases += [(label, i) for i in starts.get(p[0], ()) if tuple(words[i : i + len(p)]) == p]
    if phrases:
        score = 0.75
    for name, a in (known or library()).automata:
        free = 0
        for i in sorted(j for w in a.first for j in starts.get(w, ())):
            if i < free:
                continue
            end, furthest = a.match(words, i)
            if end >= 0:
                accepted.append((name, i, end))
                free, score = end, 1.0
            elif a.mandatory >= 8:
                score = max(score, 0.7 * furthest / a.accept)
    return sorted(phrases, key=lambda x: (x[1], x[0])), sorted(accepted, key=lambda x: (x[1], x[0])), score


def find(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, score, phrases (label, first word) and templates (name, first word, end) of each row."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    phrase = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    place = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    held = tuple(templates.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = library(held)
        for batch in batches:
            for part in slices(batch, "text"):
                b, o = buffers(part.column(1))
                n = Words(b, o, separator=_SEPARATOR).count
                raw, at = b.tobytes().lower(), o.tolist()
                phrases, places, scores = [], [], []
                for x, y in zip(at, at[1:]):
                    p, t, s = scan(_WORD.findall(raw, x, y), known) if known.anchors.search(raw, x, y) else ([], [], 0.0)
                    phrases.append([{"label": a, "start": c} for a, c in p])
                    places.append([{"name": a, "start": c, "end": e} for a, c, e in t])
                    scores.append(s)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(scores, pa.float64()), pa.array(phrases, phrase), pa.array(places, place)], names=["doc_id", "n_words", "score", "phrases", "templates"])

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_words long, score double, phrases array<struct<label:string,start:bigint>>, templates array<struct<name:string,start:bigint,end:bigint>>")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.selectExpr(
        "doc_id",
        "n_words",
        "cast(size(phrases) as bigint) as n_base",
        "array_min(phrases.start) as first_word",
        "array_max(phrases.start) as last_word",
        "array_join(array_sort(array_distinct(phrases.label)), ',') as base_labels",
        "array_join(array_sort(array_distinct(concat(phrases.label, templates.name))), ',') as labels",
        "score",
    )
