"""Licence scan: matching statistics of word streams against a generalised suffix automaton of licence templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.tokens import LOWER, PUNCT, Words, flat, slices

#: Phrases and the labels they stand for.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public licences and licence notices as they are published, without the names of their holders.
TEXTS = {
    "mit": [
        """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.
        """
    ],
    "isc": [
        """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.
        """
    ],
    "bsd": [
        """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
        USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
        """
    ],
    "zlib": [
        """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
        alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software.
        3. This notice may not be removed or altered from any source distribution.
        """
    ],
    "unlicense": [
        """
        This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
        form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
        copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
        large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law.
        """
    ],
    "apache": [
        """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.
        """
    ],
    "gpl": [
        """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details. You should have received a copy of the GNU General Public License along with this
        program. If not, see <https://www.gnu.org/licenses/>.
        """
    ],
    "lgpl": [
        """
        This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
        option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        Lesser General Public License for more details.
        """
    ],
    "agpl": [
        """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero
        General Public License for more details.
        """
    ],
    "mpl": [
        """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
        """
    ],
}

#: Well-known sentences of public licences, which stand alone too, by label.
SENTENCES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Released under the MIT License.",
        "This code is released under the MIT License.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}
#: A long text's cover is counted apart from its sentences': either is enough.
TEMPLATES = {label: [*SENTENCES.get(label, []), *TEXTS.get(label, [])] for label in sorted({*SENTENCES, *TEXTS})}
#: A match counts from so many words on; matches of a template at most so many words apart are chained.
LEAST_MATCH = 4
MOST_GAP = 8
#: Share of a template's words that its best chain must cover.
LEAST_COVER = 0.6


def words_of(text: str) -> list[str]:
    data, off = flat(pa.array([text], pa.string()))
    return [w.decode() for w in Words(LOWER[data], off, PUNCT).array().to_pylist()]


class Automaton:
    """Suffix automaton of several word sequences: every path from the start is a run of words in one of them.

    `ends[s]` holds an (template, end position) of each sequence in which state s's longest run occurs.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for t, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._append(last, word, own)
                own[last].append((t, place))
        self.ends = [set(x) for x in own]
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, own: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        own.append([])
        return len(self.next) - 1

    def _append(self, last: int, word: int, own: list) -> int:
        held = self.next[last].get(word)
        if held is not None and self.length[held] == self.length[last] + 1:
            return held
        made = None if held is not None else self._state(self.length[last] + 1, own)
        p = last
        while made is not None and p >= 0 and word not in self.next[p]:
            self.next[p][word] = made
            p = self.link[p]
        if made is not None and p < 0:
            return made
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            self.link[made] = q
            return made
        copy = self._state(self.length[p] + 1, own)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        if made is not None:
            self.link[made] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy if made is None else made

    def stream(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each word, the longest run ending there that is in a template, as (state, length)."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(word, 0)
            length = length + 1 if state else 0
            yield state, length


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        texts = [(label, words_of(t)) for label, ts in sorted(templates.items()) for t in ts]
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w.encode(), len(self.vocabulary))
        self.labels = [label for label, _ in texts]
        self.sequences = [[number(w) for w in ws] for _, ws in texts]
        self.phrases = [(label, [number(w) for w in words_of(p)]) for p, label in phrases.items()]
        self.automaton = Automaton(self.sequences)

    def spans(self, words: list[int]) -> list[tuple[int, int, int]]:
        """(template, first word, cover) of the best chain of each template that covers enough of it."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        seen = list(self.automaton.stream(words))
        for i, (state, length) in enumerate(seen):
            if length >= LEAST_MATCH and (i + 1 == len(seen) or seen[i + 1][1] <= length):  # it can't be made longer
                for t, end in self.automaton.ends[state]:
                    found.setdefault(t, []).append((i - length + 1, end - length + 1, length))
        out = []
        for t, matches in sorted(found.items()):
            best, at = 0, 0
            ends: list[tuple[int, int, int, int]] = []  # text end, template end, words covered, first word
            for a, b, n in sorted(matches):
                cover, first = n, a
                ends = [x for x in ends if x[0] >= a - MOST_GAP]  # what ends earlier is too far from all that follow
                for e, f, c, begin in ends:
                    over = max(0, e - a, f - b)
                    if over < n and 0 <= a + over - e <= MOST_GAP and 0 <= b + over - f <= MOST_GAP and c + n - over > cover:
                        cover, first = c + n - over, begin
                ends.append((a + n, b + n, cover, first))
                if cover > best:
                    best, at = cover, first
            if best >= LEAST_COVER * len(self.sequences[t]):
                out.append((t, at, best))
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row, whole texts.

    Words are runs of ASCII letters and digits (A-Z in lower case) and of characters beyond ASCII. n_base counts the
    places where a phrase's words stand consecutively; first_word and last_word are the smallest and largest of their
    starts. Every text is streamed through one suffix automaton of all templates; maximal matches of at least four words
    are chained in order, over gaps of up to eight words, and a template whose best chain covers 60 % of its words adds
    its label. score is the largest share of a template that is covered, and at least 0.5 where a phrase stands. spans
    are the (label, first word, words covered) found.

    Only stretches of words that occur in a template are streamed; any other word ends all matches. The automaton
    depends on the templates alone. Null and empty texts have no words; repeated rows and null ids are returned as they
    are; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    scanner = Scanner(templates, phrases)
    known = pa.array(list(scanner.vocabulary), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        shape = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
        for b in slices(batches, "text"):
            data, off = flat(b.column(1))
            w = Words(LOWER[data], off, PUNCT)
            code, distinct = w.encode()
            to = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy(zero_copy_only=False)
            ids = to[code] if len(code) else np.zeros(0, np.int64)
            row = w.row_of
            n_base, first, last = np.zeros(b.num_rows, np.int64), np.full(b.num_rows, -1), np.full(b.num_rows, -1)
            base: list[set[str]] = [set() for _ in range(b.num_rows)]
            for label, phrase in scanner.phrases:
                k = len(phrase)
                if len(ids) < k:
                    continue
                hit = row[: len(ids) - k + 1] == row[k - 1 :]
                for j, word in enumerate(phrase):
                    hit &= ids[j : len(ids) - k + 1 + j] == word
                at = np.flatnonzero(hit)
                np.add.at(n_base, row[at], 1)
                for r, place in zip(row[at].tolist(), (at - w.rows[row[at]]).tolist(), strict=True):
                    base[r].add(label)
                    first[r] = place if first[r] < 0 else min(first[r], place)
                    last[r] = max(last[r], place)
            labels, spans, score = [set(x) for x in base], [[] for _ in base], np.where(n_base > 0, 0.5, 0.0)
            # Stretches of template words, long enough for a match; near ones of a document are scanned together.
            # A stretch ends with its document.
            inside = ids >= 0
            fresh = np.diff(row, prepend=-1) != 0
            begin = np.flatnonzero(inside & (fresh | ~np.append(False, inside)[:-1]))
            end = np.flatnonzero(inside & np.append(fresh[1:] | ~inside[1:], True)[: len(ids)]) + 1
            rows = set(row[begin[end - begin >= LEAST_MATCH]].tolist())
            for r in sorted(rows):
                own = ids[w.rows[r] : w.rows[r + 1]]
                near = np.flatnonzero(own >= 0)
                for part in np.split(near, np.flatnonzero(np.diff(near) > 2 * MOST_GAP) + 1):
                    if len(part) < LEAST_MATCH:
                        continue
                    for t, at, cover in scanner.spans(own[part[0] : part[-1] + 1].tolist()):
                        labels[r].add(scanner.labels[t])
                        spans[r].append({"label": scanner.labels[t], "first_word": int(part[0]) + at, "n_words": cover})
                        score[r] = max(score[r], cover / len(scanner.sequences[t]))
            null = n_base == 0
            join = lambda xs: pa.array([",".join(sorted(x)) for x in xs], pa.string())
            yield pa.record_batch(
                [b.column(0), pa.array(np.diff(w.rows)), pa.array(n_base), pa.array(first, mask=null), pa.array(last, mask=null), join(base), join(labels), pa.array(score), pa.array(spans, shape)],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    shape = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, n_words: long>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, shape)
