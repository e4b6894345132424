"""License scan by conditional compression.

A line with a license cue (or a run of such lines) is a candidate block; a long line is narrowed to the sentences
with cues and those that follow them.  Each block is compressed with every template as a raw zstandard dictionary: the more of a block a
template explains, the smaller it gets.  Templates are ranked by the share of the block's own compressed size that they
save, and winners are confirmed by exact wording: the words of the template and of the block are aligned, and the
template counts as found when at most ``MAX_DIFFERENCE`` of its words were inserted, deleted or replaced and none of its
distinguishing words: names of licenses, versions and clauses (``marks``) must be the same on both sides, in order.

``TEMPLATES`` is a parameter; these are short public notices, kept as fixed values.

Defined results: null and empty texts and texts without a cue give no row; a notice that occurs several times in a text gives a
row for each place; equal savings are ranked by template name; repeated rows give repeated results; extra columns are left behind.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from rubricon.llm.common import id_and_text

#: Public license notices as their stewards word them.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-2.0-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-4.0-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-ND-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-3.0": "Licensed under CC BY 3.0.",
    "CC-BY-3.0-long": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-SA-3.0": "Licensed under CC BY-SA 3.0.",
    "CC-BY-SA-3.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-NC-3.0": "Licensed under CC BY-NC 3.0.",
    "CC-BY-NC-3.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.",
    "CC-BY-ND-3.0": "Licensed under CC BY-ND 3.0.",
    "CC-BY-ND-3.0-long": "This work is licensed under a Creative Commons Attribution-NoDerivs 3.0 Unported License.",
    "CC-BY-NC-SA-3.0": "Licensed under CC BY-NC-SA 3.0.",
    "CC-BY-NC-SA-3.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.",
    "CC-BY-NC-ND-3.0": "Licensed under CC BY-NC-ND 3.0.",
    "CC-BY-NC-ND-3.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
CUES = ("licen", "copyright", "rights reserved", "permission is hereby", "redistribution and use", "public domain", "free software", "public license", "creative commons")
CUE = re.compile("|".join(map(re.escape, CUES)))
SENTENCE_END = re.compile(r"(?<=[.!?:])\s+(?=[A-ZÀ-Ý(])|\n")
WORD = re.compile(r"[\w.+-]*\w|\w")
MAX_DIFFERENCE = 0.15
#: What tells licenses apart: a wording with other ones, or without one, is another license.
NAMES = frozenset("""affero agpl apache artistic attribution bsd cc0 clause eclipse epl gpl isc lesser lgpl mit mozilla mpl nc nd noncommercial
noderivatives noderivs sa sharealike unlicense""".split())
VERSION = re.compile(r"v?(\d{1,2}(?:\.\d+)*)")
LEVEL = 3


class Templates:
    """Compressors and words of the templates."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = {n: words_of(templates[n]) for n in self.names}
        self.marks = {n: marks(w) for n, w in self.words.items()}
        self.texts = {n: templates[n].lower().encode() for n in self.names}
        self.longest = max(map(len, self.words.values()))
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        raw = lambda t: zstandard.ZstdCompressionDict(t, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.given = {n: zstandard.ZstdCompressor(level=LEVEL, dict_data=raw(t), write_content_size=False, write_checksum=False, write_dict_id=False)
                      for n, t in self.texts.items()}

    def savings(self, block: str) -> list[tuple[float, str]]:
        """``(share of the compressed size saved, template)``, best first."""
        data = block.lower().encode()
        own = len(self.plain.compress(data))
        got = [(1 - len(self.given[n].compress(data)) / own, n) for n in self.names]
        return sorted(got, key=lambda x: (-x[0], x[1]))

    def places(self, block: str, name: str) -> list[tuple[int, int, int]]:
        """``(start, end, differing words)`` of every place of ``block`` that words the template closely enough."""
        want, out = self.words[name], []
        found = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(block)]
        have = [w for w, _, _ in found]
        allowed = int(MAX_DIFFERENCE * len(want))
        at = 0
        while at + len(want) - allowed <= len(have):
            # an anchor: a word of the template's beginning; without one in reach the place cannot qualify
            if have[at] not in want[:allowed + 1]:
                at += 1
                continue
            lead = want.index(have[at])
            best = None
            for size in range(max(1, len(want) - lead - allowed), len(want) - lead + allowed + 1):
                if at + size > len(have):
                    break
                if marks(have[at:at + size]) != self.marks[name]:
                    continue
                d = differing_words(want, have[at:at + size])
                if best is None or d < best[0]:
                    best = (d, size)
            if best is not None and best[0] <= allowed:
                end = at + best[1]
                out.append((found[at][1], found[end - 1][2], best[0]))
                at = end
            else:
                at += 1
        return out


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def marks(words: list[str]) -> list[str]:
    """The distinguishing words among ``words``, in order; versions without trailing zeros."""
    out = []
    for word, after in zip(words, [*words[1:], ""], strict=True):
        for part in word.split("-") if "." not in word or VERSION.fullmatch(word) else [word]:
            version = VERSION.fullmatch(part)
            if version:
                out.append(re.sub(r"(\.0)+$", "", version[1]))
            elif part in NAMES or (part == "library" and after == "general"):
                out.append(part)
    return out


def differing_words(a: list[str], b: list[str]) -> int:
    """Words inserted, deleted or replaced between two wordings."""
    ops = SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    return sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in ops if tag != "equal")


def candidate_blocks(text: str, reach: int):
    """``(start, end)`` of the sentences that hold a cue, with sentences of the same line that follow within ``reach``
    words (a notice's later sentences may hold no cue); neighbouring ones are one block."""
    low = text.lower()
    if not any(c in low for c in CUES):
        return
    if len(low) != len(text):                    # a character whose lower case is longer: positions must agree
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    spans: list[list[int]] = []
    cuts = [0]
    for m in SENTENCE_END.finditer(text):
        cuts.append(m.end())
    cuts.append(len(text))
    room = 0
    for start, end in zip(cuts, cuts[1:], strict=False):
        cue = CUE.search(low, start, end)
        goes_on = bool(spans) and spans[-1][1] == start
        if cue:
            room = reach
        if goes_on and (cue or (room > 0 and text[start - 1] != "\n")):
            spans[-1][1] = end
        elif cue:
            spans.append([start, end])
        room = room - text.count(" ", start, end) if text[end - 1:end] != "\n" else 0
    yield from map(tuple, spans)


def scan_text(text: str, reach: int, in_block) -> list[tuple]:
    """``(license, start, length, saving, differing words)`` by position; ``in_block`` gives a block's confirmed places."""
    rows = []
    for start, end in candidate_blocks(text, reach):
        taken: list[tuple[int, int]] = []
        for saving, name, s, e, differing in in_block(text[start:end]):
            if any(s < t_end and t_start < e for t_start, t_end in taken):
                continue                          # a better template explains these words
            taken.append((s, e))
            rows.append((name, start + s, e - s, saving, differing))
    return sorted(rows, key=lambda r: (r[1], r[0]))


def found_in_block(block: str, templates: Templates) -> list[tuple]:
    """Confirmed places of a block: fewest differing words first, then larger saving, then name."""
    own = max(1, len(words_of(block)))
    rows = []
    for saving, name in templates.savings(block):
        # a template whose words are a share of the block can save at most about that share
        if saving < 0.3 * min(1.0, len(templates.words[name]) / own):
            continue
        rows += [(saving, name, s, e, d) for s, e, d in templates.places(block, name)]
    return sorted(rows, key=lambda r: (r[4] / len(templates.words[r[1]]), -len(templates.words[r[1]]), -r[0], r[1], r[2]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``(doc_id, license, start, length, saving, differing_words)``: one row for each confirmed notice; ``start`` and
    ``length`` are code points."""
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
                        ("saving", pa.float64()), ("differing_words", pa.int64())])

    def run(batches):
        made = Templates(templates)

        @lru_cache(maxsize=20_000)               # the same notice is compressed once
        def in_block(block: str):
            return tuple(found_in_block(block, made))

        for b in batches:
            rows = [(doc_id, *r) for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                    for r in scan_text(text, made.longest, in_block)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return id_and_text(docs).mapInArrow(run, "doc_id long, license string, start long, length long, saving double, differing_words long")
