"""License scans: patience alignment of license texts with documents.

Words are runs of ASCII letters and digits, lower-cased, and runs of other bytes of letters. A
document's two-word sequences are looked up among those that occur once in a template. A hit says where the
template would begin; hits that agree about it, up to a quarter of the template, and advance in both make a group, so each
copy has a group of its own however close, overlapping or cut into by others it stands. A group that holds PAIRS of
the template's sequences makes a window, which ends where the next copy of the same template begins. Window and
template are aligned the patience way: words that occur once in either are anchors, the longest chain of anchors that rises
in both is kept, and the gaps between them are aligned again; where a gap has no such word, equal words at its ends are
matched. The matched share of the template is its coverage. Of overlapping finds the one with more matched words stays.
Work is linear in the text, times the size of a template.

Cases. Null or empty text: nothing found. Rows are independent: repeated rows, null ids pass. Texts of any
length are read whole. Ties: higher coverage, then the earlier start, then the name. Empty tables give empty results.
Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import grams, sliced, steps, texts, words

COVERAGE = 0.85
#: Share of a template's own word pairs that a candidate must hold.
PAIRS = 0.25
#: Public license notices and grants.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "licensed under the GNU General Public License, version 3",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
}
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = [ord(c.lower()) if (c := chr(i)).isalnum() else 32 for i in range(128)]


def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first, that rises in the second (patience piles)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(y)
            piles.append(i)
        else:
            tops[at], piles[at] = y, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (in a, in b) by patience alignment; equal words, rising in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        places: dict = {}
        for side, (x, lo, hi) in enumerate(((a, a0, a1), (b, b0, b1))):
            for i in range(lo, hi):
                places.setdefault(x[i], ([], []))[side].append(i)
        anchors = chain(sorted((x[0], y[0]) for x, y in places.values() if len(x) == len(y) == 1))
        if not anchors:
            continue
        out += anchors
        for (x, y), (x2, y2) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            gaps.append((x + 1, x2, y + 1, y2))
    return sorted(out)


def gathered(pairs: list[tuple[int, int]], a: list, b: list) -> list[tuple[int, int]]:
    """The alignment with the matches at its ends drawn close: a block that stands further off than it is long goes, and one whose words follow nearer by as well is matched there."""
    for _ in range(2):  # the end, then (mirrored) the beginning
        while len(pairs) > 1:
            k = next((i for i in range(len(pairs) - 1, 0, -1) if pairs[i][0] - pairs[i - 1][0] > pairs[i][1] - pairs[i - 1][1]), 0)
            if not k:
                break
            nearer, inserted = pairs[:k], pairs[k][0] - pairs[k - 1][0] - (pairs[k][1] - pairs[k - 1][1])
            while nearer[-1][0] + 1 < len(a) and nearer[-1][1] + 1 < len(b) and a[nearer[-1][0] + 1] == b[nearer[-1][1] + 1]:
                nearer.append((nearer[-1][0] + 1, nearer[-1][1] + 1))
            if len(pairs) - k >= inserted and len(nearer) < len(pairs):
                break
            pairs = nearer
        pairs, a, b = [(len(a) - 1 - x, len(b) - 1 - y) for x, y in pairs[::-1]], a[::-1], b[::-1]
    return pairs


@dataclass
class Templates:
    names: list[str]
    words: list[list[int]]
    keys: np.ndarray  # sorted two-word hashes
    of: np.ndarray  # template of each
    at: np.ndarray  # place in it

    @classmethod
    def of_texts(cls, templates: dict[str, str]) -> Templates:
        names, own = list(templates), []
        for t in templates.values():
            data = _PLAIN[np.frombuffer(t.encode(), np.uint8)]
            own.append(words(data, np.zeros(1, np.int64))[2])
        keys, of, at = [], [], []
        for i, h in enumerate(own):
            g, first, n = np.unique(grams(h, 2), return_index=True, return_counts=True)
            keys.append(g[n == 1])
            at.append(first[n == 1])
            of.append(np.full(len(keys[-1]), i))
        keys, of, at = map(np.concatenate, (keys, of, at))
        order = np.argsort(keys, kind="stable")
        return cls(names, [h.tolist() for h in own], keys[order], of[order], at[order])

    def windows(self, hashes: np.ndarray):
        """(template, first word, word after the last) where a template may stand."""
        g = grams(hashes, 2)
        lo = np.searchsorted(self.keys, g)
        found = np.flatnonzero((lo < len(self.keys)) & (self.keys[np.minimum(lo, len(self.keys) - 1)] == g))
        by: dict[int, list[tuple[int, int]]] = {}
        for p in found:
            j = lo[p]
            while j < len(self.keys) and self.keys[j] == g[p]:
                by.setdefault(int(self.of[j]), []).append((int(p), int(self.at[j])))
                j += 1
        for t, hits in by.items():
            m = len(self.words[t])
            slack, least = m // 4 + 2, max(1, int(PAIRS * np.count_nonzero(self.of == t)))
            groups = [x for x in self._groups(hits, slack) if x[5] >= least]
            for k, (p0, p1, q1, d0, d1, _) in enumerate(groups):
                before = groups[k - 1][1] + 2 if k and groups[k - 1][1] < p0 else 0
                after = groups[k + 1][0] if k + 1 < len(groups) and groups[k + 1][0] > p1 else len(hashes)
                yield t, max(0, d0 - slack, min(before, p0)), min(len(hashes), d1 + m + slack, max(after, p1 + 2))

    @staticmethod
    def _groups(hits: list[tuple[int, int]], slack: int) -> list[list[int]]:
        """[first p, last p, last q, least p - q, largest p - q, hits] of hits whose p - q agree and whose q rise with p; by first p."""
        done, open_ = [], {}
        for p, q in hits:
            d = p - q
            near = [(abs(d - (x[1] - x[2])), k) for k in (d // slack - 1, d // slack, d // slack + 1) if (x := open_.get(k)) and x[2] < q]
            gap, k = min(near, default=(slack + 1, 0))
            if gap <= slack:
                x = open_.pop(k)
                x[1], x[2], x[3], x[4], x[5] = p, q, min(x[3], d), max(x[4], d), x[5] + 1
            else:
                x = [p, p, q, d, d, 1]
            if (old := open_.get(d // slack)) is not None:
                done.append(old)
            open_[d // slack] = x
        return sorted([*done, *open_.values()])

    def find(self, hashes: np.ndarray, coverage: float) -> list[tuple[int, int, str, float]]:
        """(first word, word after the last, name, coverage) without overlaps."""
        got = []
        for t, lo, hi in self.windows(hashes):
            own = hashes[lo:hi].tolist()
            pairs = gathered(align(own, self.words[t]), own, self.words[t])
            share = len(pairs) / len(self.words[t])
            if share >= coverage:
                got.append((-len(pairs), -share, lo + pairs[0][0], lo + pairs[-1][0] + 1, self.names[t]))
        out: list[tuple[int, int, str, float]] = []  # by start, and so by end
        for _, share, s, e, name in sorted(got):
            i = bisect_right(out, (s, e))
            if (not i or out[i - 1][1] <= s) and (i == len(out) or e <= out[i][0]):
                out.insert(i, (s, e, name, -share))
        return out


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and licenses: array<struct<name, start, end, coverage>>; offsets are code points, end exclusive."""
    known = Templates.of_texts(templates or TEMPLATES)
    span = pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])

    def run(batches):
        for b in sliced(batches):
            rows: list[list[dict]] = []
            for lo, hi, data, offsets in steps(texts(b.column(1))):
                starts, ends, hashes = words(_PLAIN[data], offsets[:-1])
                first = np.searchsorted(starts, offsets)
                for i in range(hi - lo):
                    own = hashes[first[i] : first[i + 1]]
                    if found := known.find(own, coverage) if len(own) > 1 else []:
                        chars = np.concatenate([[0], np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)])  # code points before each byte
                        place = lambda at, i=i, chars=chars: int(chars[at - offsets[i]])
                        rows.append([{"name": n, "start": place(starts[first[i] + s]), "end": place(ends[first[i] + e - 1]), "coverage": c} for s, e, n, c in found])
                    else:
                        rows.append([])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(span))], names=["id", "licenses"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, licenses array<struct<name:string,start:bigint,end:bigint,coverage:double>>").withColumnRenamed("id", id_col)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    found = find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    written = F.array_join(F.transform("licenses", lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), written.alias("licenses"))
