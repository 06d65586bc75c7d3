"""License scans: winnowed fingerprints pick candidates, banded alignment of words measures them.

Templates and texts are cut into words (lower case, punctuation dropped). Of every window of neighbouring k-grams of words
the least hash is a fingerprint; an inverted index names the templates that hold it, and a text that shares one is a
candidate. How many words a gram has and how many grams a window follows from the template's length: any alignment within
the band that reaches the coverage has a run of matched words long enough to hold a whole window, so none is lost. A
candidate's words near each diagonal bound what an alignment there can match; whatever may reach the coverage is aligned,
word by word, within a band.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import as_bytes, in_slices, mix, odd_numbers, texts, words

#: Diagonals counted at a time, and cells aligned at a time.
DIAGONALS, CELLS = 4096, 1 << 16
#: Words of a fingerprint at most.
MOST_WORDS = 3

#: Public notices and license texts.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. "
        "If not, see <https://www.gnu.org/licenses/>."
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
}
#: Bytes that belong to words: letters, digits, and whatever is beyond ASCII.
LETTERS = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def word_hashes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, and start, end and hash of each word."""
    raw, offsets = as_bytes(pc.ascii_lower(strings))
    return raw, offsets, *words(LETTERS[raw], offsets)


class Index:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.names = sorted(templates)
        every = [word_hashes(pa.array([templates[x]]))[4] for x in self.names]
        self.vocabulary = np.unique(np.concatenate(every))
        self.words = [np.searchsorted(self.vocabulary, w) for w in every]
        self.need = [max(1, math.ceil(coverage * len(w))) for w in self.words]
        self.member = np.zeros((len(every), len(self.vocabulary)), bool)
        for t, w in enumerate(self.words):
            self.member[t, w] = True
        self.order = [np.argsort(w, kind="stable") for w in self.words]
        self.shapes = [self.shape(t) for t in range(len(every))]
        self.inverted: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for k, w in sorted(set(self.shapes)):
            own = [(t, winnowed(every[t], np.array([0, len(every[t])]), k, w)[0]) for t in range(len(every)) if self.shapes[t] == (k, w)]
            prints = np.concatenate([f for _, f in own])
            order = np.argsort(prints, kind="stable")
            self.inverted[k, w] = prints[order], np.repeat([t for t, _ in own], [len(f) for _, f in own])[order]
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def shape(self, t: int) -> tuple[int, int]:
        """Words of a gram and grams of a window: a run of that many words is matched in every alignment that reaches the coverage.

        An alignment leaves out at most ``m - need`` words of the template, and its place holds at most ``m + 2 x band`` words of the text, of which it matches ``need``; each word that is passed over on either side may end one run."""
        m, need = len(self.words[t]), self.need[t]
        breaks = (m - need) + (m + 2 * self.band(t) - need)
        run = -(-need // (breaks + 1))
        k = min(MOST_WORDS, (run + 2) // 2)
        return k, run - k + 1

    def candidates(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which rows share a fingerprint with which templates; ``first`` is each row's first word, and at last their number."""
        out = np.zeros((len(first) - 1, len(self.words)), bool)
        for (k, w), (prints, template) in self.inverted.items():
            found, place = winnowed(h, first, k, w)
            left, right = np.searchsorted(prints, found, side="left"), np.searchsorted(prints, found, side="right")
            n = right - left
            post = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out[np.repeat(np.searchsorted(first, place, side="right") - 1, n), template[post]] = True
        return out

    def codes(self, h: np.ndarray) -> np.ndarray:
        """The vocabulary's number of each word, -1 for a word of no template."""
        out = np.full(len(h), -1, np.int64)
        seen = np.flatnonzero(self.known[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[seen]), len(self.vocabulary) - 1)
        good = self.vocabulary[at] == h[seen]
        out[seen[good]] = at[good]
        return out

    def stretches(self, code: np.ndarray, first: np.ndarray, candidate: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, template, low, high): the diagonals, from low to before high, around which a candidate row has enough words of the template. ``first`` is each row's first word."""
        at = np.flatnonzero(code >= 0)
        of = np.searchsorted(first, at, side="right") - 1
        out = []
        for t, need in enumerate(self.need):
            p = at[self.member[t, code[at]] & candidate[of, t]]
            if len(p) < need:
                continue
            row = np.searchsorted(first, p, side="right") - 1
            start, end = p[: len(p) - need + 1], p[need - 1 :]
            near = np.flatnonzero((end - start < len(self.words[t]) + 2 * self.band(t)) & (row[: len(start)] == row[need - 1 :]))
            if not len(near):
                continue
            row = row[near]
            low = end[near] - len(self.words[t]) - self.band(t) + 1 - first[row]
            high = start[near] + self.band(t) + 1 - first[row]
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (low[1:] > high[:-1])])
            out += zip(row[new].tolist(), [t] * len(new), low[new].tolist(), high[np.r_[new[1:] - 1, len(near) - 1]].tolist(), strict=True)
        return out

    def most(self, t: int, text: np.ndarray, low: int, high: int) -> np.ndarray:
        """For each diagonal from low to before high, how many words of the template occur in ``text`` within the band: no alignment has more."""
        band = self.band(t)
        a, z = max(0, low - band), max(0, min(len(text), high + band + len(self.words[t])))
        own = self.words[t][self.order[t]]
        left, right = np.searchsorted(own, text[a:z], side="left"), np.searchsorted(own, text[a:z], side="right")
        n = right - left
        place = self.order[t][np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        diagonal = np.repeat(np.arange(a, z), n) - place
        order = np.lexsort((diagonal, place))
        place, diagonal = place[order], diagonal[order]
        end = diagonal + band + 1  # a word of the template counts once, however often it occurs within the band
        end[:-1] = np.where(place[1:] == place[:-1], np.minimum(end[:-1], diagonal[1:] - band), end[:-1])
        begin, end = np.clip(diagonal - band, low, high) - low, np.clip(end, low, high) - low
        return np.cumsum(np.bincount(begin, minlength=high - low + 1) - np.bincount(end, minlength=high - low + 1))[:-1]

    def find(self, t: int, text: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
        """(matched words, first, last word) of the template's places on the diagonals from low to before high; of places that overlap the best."""
        need, band = self.need[t], self.band(t)
        centres = [c + b for b in range(low, high, DIAGONALS) if len(c := np.flatnonzero(self.most(t, text, b, min(b + DIAGONALS, high)) >= need))]
        if not centres:
            return []
        centre = np.concatenate(centres)
        score = matched(self.words[t], text, centre, band)
        out: list[tuple[int, int, int]] = []
        done: set[int] = set()
        for at in np.lexsort((centre, -score)).tolist():
            if score[at] < need:
                break
            if int(centre[at]) in done:
                continue
            n, first, last, least, greatest = align(self.words[t], text, int(centre[at]), band)
            done.update(range(greatest - band, least + band + 1))  # their bands hold the same alignment, and none has a better one
            if not any(first <= z and a <= last for _, a, z in out):
                out.append((n, first, last))
        return out

    def band(self, t: int) -> int:
        return 2 + len(self.words[t]) // 8


def winnowed(h: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of rows of words (hashes ``h``; ``first`` is where each row begins, and at last their number) and where they stand: the least gram of ``k`` words in each window of ``w``, the last of equal ones."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram = np.zeros(n, np.uint64)
    for i, factor in enumerate(odd_numbers(k, 17)):
        gram += h[i : i + n] * factor
    gram = mix(gram)
    row = np.searchsorted(first, np.arange(len(h)), side="right") - 1
    whole = row[: n] == row[k - 1 :]
    if w == 1:
        place = np.flatnonzero(whole)
        return gram[place], place
    if n < w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = w - 1 - np.argmin(np.lib.stride_tricks.sliding_window_view(gram, w)[:, ::-1], axis=1)
    place = np.unique((np.arange(n - w + 1) + least)[row[: n - w + 1] == row[w + k - 2 :]])
    return gram[place], place


def matched(template: np.ndarray, text: np.ndarray, centre: np.ndarray, band: int) -> np.ndarray:
    """The matched words of the best alignment within ``band`` of each diagonal in ``centre``."""
    width, size = 2 * band + 1, max(1, CELLS // (2 * band + 1))
    out = np.zeros(len(centre), np.int64)
    for part in range(0, len(centre), size):
        at = centre[part : part + size, None] + np.arange(-band, band + 1)
        least = int(at.min())
        window = np.full(int(at.max()) - least + len(template), -1, np.int64)
        a, z = max(0, least), min(len(text), least + len(window))
        window[a - least : z - least] = text[a:z]
        at -= least
        score = np.zeros((len(at), width + 1), np.int32)  # with a last column that stays 0
        for i, w in enumerate(template):
            best = np.maximum(score[:, :-1] + (window[at + i] == w), score[:, 1:])
            np.maximum.accumulate(best, axis=1, out=score[:, :-1])
        out[part : part + size] = score[:, -2]
    return out


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int, int, int]:
    """(matched words, first, last matched word of the text, least, greatest diagonal) of the best alignment on diagonals within ``band`` of ``diagonal``."""
    m, width = len(template), 2 * band + 1
    low = diagonal - band
    score = np.zeros(width, np.int32)
    rows = [score]
    at = np.arange(width) + low
    hits = np.zeros((m, width), bool)
    for i, w in enumerate(template):
        j = at + i
        inside = (j >= 0) & (j < len(text))
        hits[i] = inside & (text[np.clip(j, 0, len(text) - 1)] == w)
        score = np.maximum.accumulate(np.maximum(score + hits[i], np.r_[score[1:], 0]))
        rows.append(score)
    i, k = m, int(np.argmax(score))
    total, first, last, used = int(score[k]), -1, -1, [k]
    while i and rows[i][k]:
        if hits[i - 1, k] and rows[i][k] == rows[i - 1][k] + 1:
            first = k + low + i - 1
            last = first if last < 0 else last
            used.append(k)
            i -= 1
        elif k + 1 < width and rows[i - 1][k + 1] == rows[i][k]:
            i, k = i - 1, k + 1
        elif rows[i - 1][k] == rows[i][k]:
            i -= 1
        else:
            k -= 1
    used = used[1:] or used
    return total, first, last, min(used) + low, max(used) + low


def scan(df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = 0.8) -> DataFrame:
    """(doc_id, template, coverage, n_matched, start, end): where a row's whole text holds ``coverage`` or more of a template's words, in order.

    The words lie within a band of 2 and an eighth of the template's words on either side of one diagonal; every such place
    is found, whatever the edits between them; of equally good places that overlap the first counts. A null id stays null. Places are in bytes of the UTF-8 text. A text may hold a template more than
    once; places of one template that overlap count once, by the best; repeated rows each give theirs; null and empty texts
    hold none, and nothing holds a template without a word. The index is as large as the templates, not the corpus; rows are
    scanned where they were read, no shuffle."""
    chosen = {name: t for name, t in (TEMPLATES if templates is None else templates).items() if len(word_hashes(pa.array([t]))[4])}
    schema = "doc_id long, template string, coverage double, n_matched int, start long, end long"
    if not chosen:
        return df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen, coverage)
        for b in in_slices(batches):
            _, offsets, start, end, h = word_hashes(b.column("text"))
            first = np.searchsorted(start, offsets)
            code = index.codes(h)
            spans: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
            for row, t, low, high in index.stretches(code, first[:-1], index.candidates(h, first)):
                held = spans.setdefault((row, t), [])
                held += [x for x in index.find(t, code[first[row] : first[row + 1]], low, high) if not any(x[1] <= z and a <= x[2] for _, a, z in held)]
            found = [
                (b.column("doc_id")[row].as_py(), index.names[t], n / len(index.words[t]), n, int(start[first[row] + a] - offsets[row]), int(end[first[row] + z] - offsets[row]))
                for (row, t), held in spans.items()
                for n, a, z in held
            ]
            if found:
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*found, strict=True), kinds, strict=True)], names=["doc_id", "template", "coverage", "n_matched", "start", "end"])

    return texts(df, id_col, text_col).mapInArrow(run, schema)
