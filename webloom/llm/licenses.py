"""License scan: words in a row for plain mentions, and template-markup matching for license texts.

A template is license wording with markup: <<beginOptional>> ... <<endOptional>> may be absent,
<<var;min;max>> stands for min to max words of any kind. Each template is compiled into an automaton
over words (optional and replaceable regions become empty moves); a text has the license where the
automaton accepts a run of its words, that is, where all mandatory wording matches exactly. Case and
punctuation don't count. Of runs from one place the longest is taken, and runs don't overlap.

A template is tried only on texts that have its key word (its longest mandatory word), from places
where it can begin. Null and empty texts have no words and no labels. Rows that repeat a doc_id
return each. Other columns of the input are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.shingles import column_bytes

# Phrases and labels.
PHRASES = [(b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl")]

# Public license wording. Texts and notices are whole: all but the marked regions is mandatory.
TEMPLATES = {
    "mit-text": """<<beginOptional>>The MIT License<<endOptional>> <<beginOptional>>MIT License<<endOptional>> <<beginOptional>>Copyright <<var;0;20>><<endOptional>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;1;8>> (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next
        paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var;1;10>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
        THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """<<beginOptional>>ISC License<<endOptional>> <<beginOptional>>Copyright <<var;0;20>><<endOptional>> Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>>
        distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;1;8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL <<var;1;8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-text": """<<beginOptional>>Copyright <<var;0;20>> All rights reserved.<<endOptional>> Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: <<var;0;1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<var;0;1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. <<beginOptional>><<var;0;1>> Neither the name of <<var;1;12>> nor the names of <<beginOptional>>its<<endOptional>> contributors may be used to endorse
        or promote products derived from this software without specific prior written permission.<<endOptional>> THIS SOFTWARE IS PROVIDED BY <<var;1;10>> "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;1;10>> BE LIABLE FOR
        ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
        PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
        WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib-text": """<<beginOptional>>Copyright <<var;0;20>><<endOptional>> This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions: <<var;0;1>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<var;0;1>> Altered source versions must be plainly marked as such, and must
        not be misrepresented as being the original software. <<var;0;1>> This notice may not be removed or altered from any source distribution.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
        source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
        software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL <<var;1;10>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
        OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. <<beginOptional>>For more information, please refer to <<var;1;6>><<endOptional>>""",
    "apache-notice": """<<beginOptional>>Copyright <<var;0;20>><<endOptional>> Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at <<var;1;8>> Unless required by applicable law or agreed to in writing, software distributed under
        the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "gpl-notice": """This <<var;1;4>> is free software; you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>>
        General Public License as published by the Free Software Foundation; either version <<var;1;2>> of the License, or (at your option) any later version. This <<var;1;4>> is distributed in the
        hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License for more details.
        <<beginOptional>>You should have received a copy of the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License along with this
        <<var;1;4>> If not, see <<var;1;6>><<endOptional>>""",
    "apache-statement": "licensed under the Apache License <<beginOptional>>version <<var;1;2>><<endOptional>>",
    "gpl-statement": """<<beginOptional>>This <<var;1;3>> is<<endOptional>> licensed under the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>>
        General Public License <<beginOptional>>version <<var;1;2>><<endOptional>>""",
    "mit-statement": "<<beginOptional>>This <<var;1;3>> is<<endOptional>> <<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "cc-statement": "<<beginOptional>>This <<var;1;3>> is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY <<beginOptional>>NC<<endOptional>> <<beginOptional>>SA<<endOptional>> <<beginOptional>>ND<<endOptional>> <<var;2;2>>",
    "spdx-tag": "SPDX License Identifier <<var;1;3>>",
}
SCORES = {"text": 1.0, "notice": 1.0, "statement": 0.75, "tag": 0.75}  # by the last part of a label; a mention alone has MENTION
MENTION = 0.5

_MARK = re.compile(r"<<beginOptional>>|<<endOptional>>|<<var;(\d+);(\d+)>>|([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else (c + 32 if 65 <= c <= 90 else 32) for c in range(256))


class Automaton:
    """A template as states 0..n; from a state a word leads on, any word leads on, or nothing (free)."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.word: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.free: list[set[int]] = [set()]
        opened: list[int] = []
        depth_words: list[bytes] = []
        for m in _MARK.finditer(template.lower().replace("beginoptional", "beginOptional").replace("endoptional", "endOptional")):
            if m[0] == "<<beginOptional>>":
                opened.append(len(self.word) - 1)
            elif m[0] == "<<endOptional>>":
                self.free[opened.pop()].add(len(self.word) - 1)
                self._state()
                self.free[len(self.word) - 2].add(len(self.word) - 1)
            elif m[1] is not None:
                low, high = int(m[1]), int(m[2])
                from_ = len(self.word) - 1
                ends = []
                for i in range(high):
                    if i >= low:
                        ends.append(from_ + i)
                    self.any[-1] = len(self.word)
                    self._state()
                for e in ends:
                    self.free[e].add(len(self.word) - 1)
            else:
                w = m[3].encode()
                self.word[-1][w] = len(self.word)
                self._state()
                if not opened:
                    depth_words.append(w)
        self.last = len(self.word) - 1
        self.key = max(depth_words, key=lambda w: (len(w), w))
        self.start = self.closure({0})
        self.first = {w for s in self.start for w in self.word[s]} if all(self.any[s] is None for s in self.start) else None

    def _state(self) -> None:
        self.word.append({})
        self.any.append(None)
        self.free.append(set())

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def match(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest accepted run of words from at."""
        states, end = self.start, None
        for i in range(at, len(words)):
            w = words[i]
            states = {t for s in states for t in (self.word[s].get(w), self.any[s]) if t is not None}
            if not states:
                return end
            states = self.closure(states)
            if self.last in states:
                end = i + 1
        return end

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        out, at = [], 0
        while at < len(words):
            end = self.match(words, at) if self.first is None or words[at] in self.first else None
            if end:
                out.append((at, end))
            at = end or at + 1
        return out


def compile_all(templates: dict[str, str] = TEMPLATES) -> list[Automaton]:
    return [Automaton(k, v) for k, v in templates.items()]


def scan_text(raw: bytes, automata: list[Automaton]) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int]]]:
    """Of a text in UTF-8: number of words, phrase places (first word, label), template runs (label, first word, end)."""
    flat = raw.translate(_GAP)
    keyed = [a for a in automata if a.key in flat]
    if not keyed and b"license" not in flat:
        return len(flat.split()), [], []
    words = flat.split()
    places = []
    for phrase, label in PHRASES:
        want = phrase.split()
        n, i = len(want), -1
        while True:
            try:
                i = words.index(want[0], i + 1)
            except ValueError:
                break
            if words[i : i + n] == want:
                places.append((i, label))
    have = set(words)
    return len(words), sorted(places), [(a.label, x, y) for a in keyed if a.key in have for x, y in a.find(words)]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, runs (label:first:end of each accepted text).

    score: the best of what is accepted: 1 for a whole text or notice (and templates of one's own), 0.75 for a statement or tag that names a license, 0.5 for a mention alone, else 0.
    """

    def run(batches):
        automata = compile_all(templates)
        for b in batches:
            rows: list[list] = [[] for _ in range(8)]
            for raw in column_bytes(b.column(1)):
                n, places, runs = scan_text(raw, automata)
                base = {x for _, x in places}
                own = base | {x for x, _, _ in runs}
                row = (n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(own)), max([SCORES.get(x.rpartition("-")[2], 1.0) for x, _, _ in runs], default=MENTION if places else 0.0), ",".join(f"{x}:{i}:{j}" for x, i, j in runs))
                for x, v in zip(rows, row, strict=True):
                    x.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "runs"]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, runs string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
