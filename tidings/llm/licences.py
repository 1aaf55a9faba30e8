"""License scans: template markup compiled to token automata.

A template is license wording with two kinds of marks. ``<<opt>>...<</opt>>`` encloses words
that may be missing; ``<<var N>>`` stands for up to N words of any kind, such as names and
years. A template compiles to a nondeterministic automaton over words. It accepts a place
of a text when all wording outside the marks stands there exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import LOWER, byte_class, map_blocks, text_bytes, whole_text, word_spans

WORD = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases that name a license wherever they stand, and their labels.
BASE = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# The whole wording of licenses, with their optional and replaceable regions.
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are"
    " permitted provided that the following conditions are met: <<opt>>1<</opt>> Redistributions"
    " of source code must retain the above copyright notice, this list of conditions and the"
    " following disclaimer. <<opt>>2<</opt>> Redistributions in binary form must reproduce the"
    " above copyright notice, this list of conditions and the following disclaimer in the"
    " documentation and/or other materials provided with the distribution."
)
_BSD_ENDORSEMENT = (
    " <<opt>>3<</opt>> Neither the name of <<var 8>> nor the names of its contributors may be"
    " used to endorse or promote products derived from this software without specific prior"
    " written permission."
)
_BSD_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY <<var 8>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES,"
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR"
    " A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var 8>> BE LIABLE FOR ANY DIRECT,"
    " INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT"
    " LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR"
    " BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,"
    " STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF"
    " THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
LICENSES = {
    "mit-license": "Permission is hereby granted, free of charge, to any person obtaining a copy"
    " of this software and associated documentation files <<opt>>(the Software)<</opt>>, to deal"
    " in the Software without restriction, including without limitation the rights to use, copy,"
    " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
    " permit persons to whom the Software is furnished to do so, subject to the following"
    " conditions: The above copyright notice and this permission notice <<opt>>(including the"
    " next paragraph)<</opt>> shall be included in all copies or substantial portions of the"
    " Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,"
    " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
    " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var 8>> BE LIABLE FOR ANY CLAIM, DAMAGES"
    " OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT"
    " OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-license": "Permission to use, copy, modify, and/or distribute this software for any"
    " purpose with or without fee is hereby granted, provided that the above copyright notice"
    " and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND"
    " <<var 8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED"
    " WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var 8>> BE LIABLE FOR ANY"
    " SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING"
    " FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER"
    " TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS"
    " SOFTWARE",
    "bsd-2-clause": _BSD_CONDITIONS + _BSD_DISCLAIMER,
    "bsd-3-clause": _BSD_CONDITIONS + _BSD_ENDORSEMENT + _BSD_DISCLAIMER,
}

# Wording of common notices; a grant is the opening of its license, no more.
TEMPLATES = {
    **LICENSES,
    "mit-notice": "<<opt>>this software is<</opt>> <<var 2>> under the <<opt>>terms of the"
    "<</opt>> MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy"
    " of this software and associated documentation files <<opt>>(the Software)<</opt>>, to"
    " deal in the Software without restriction, including without limitation the rights to"
    " use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
    " Software",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any"
    " purpose with or without fee is hereby granted, provided that the above copyright"
    " notice and this permission notice appear in all copies",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without"
    " modification, are permitted provided that the following conditions are met",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 <<opt>>(the License)<</opt>>",
    "gpl-2.0": "<<opt>>GNU<</opt>> General Public License <<opt>>as published by the Free"
    " Software Foundation either<</opt>> version 2",
    "gpl-3.0": "<<opt>>GNU<</opt>> General Public License <<opt>>as published by the Free"
    " Software Foundation either<</opt>> version 3",
    "cc-by-4.0": "licensed under <<opt>>a<</opt>> <<opt>>Creative Commons<</opt>> CC BY 4.0",
    "cc-by-sa-4.0": "licensed under <<opt>>a<</opt>> <<opt>>Creative Commons<</opt>> CC BY-SA 4.0",
    "cc-by-nc-4.0": "licensed under <<opt>>a<</opt>> <<opt>>Creative Commons<</opt>> CC BY-NC 4.0",
}


def words(text: bytes) -> list[bytes]:
    return _WORDS.findall(text.translate(LOWER.tobytes()))


@dataclass(frozen=True)
class Automaton:
    """States are numbers; ``step`` is keyed by state and word, ``any_word`` by state."""

    step: dict[tuple[int, bytes], int]
    any_word: dict[int, int]
    skip: dict[int, tuple[int, ...]]
    final: int
    required: bytes  # a word every accepted place holds

    def closure(self, states: set[int]) -> set[int]:
        found, todo = set(states), list(states)
        while todo:
            for state in self.skip.get(todo.pop(), ()):
                if state not in found:
                    found.add(state)
                    todo.append(state)
        return found

    def accept(self, text: list[bytes], start: int) -> int | None:
        """End of the shortest accepted place that begins at ``start``."""
        states = self.closure({0})
        for at in range(start, len(text)):
            moved = {self.step[s, text[at]] for s in states if (s, text[at]) in self.step}
            moved |= {self.any_word[s] for s in states if s in self.any_word}
            if not moved:
                return None
            states = self.closure(moved)
            if self.final in states:
                return at + 1
        return None

    def starts(self) -> set[bytes] | None:
        """Words a place can begin with; None if any word can."""
        states = self.closure({0})
        if any(s in self.any_word for s in states):
            return None
        return {word for (s, word) in self.step if s in states}


def compile_template(template: str) -> Automaton:
    """The automaton of a template. Optional regions may be nested."""
    step: dict[tuple[int, bytes], int] = {}
    any_word: dict[int, int] = {}
    skip: dict[int, set[int]] = {}
    state, opened, required = 0, [], []
    for part in re.split(r"(<<[^>]*>>)", template):
        mark = re.fullmatch(r"<<(opt|/opt|var (\d+))>>", part)
        if mark is None:
            if part.startswith("<<"):
                raise ValueError(f"unknown mark {part}")
            for word in words(part.encode()):
                step[state, word] = state + 1
                state += 1
                if not opened:
                    required.append(word)
        elif mark[1] == "opt":
            opened.append(state)
        elif mark[1] == "/opt":
            skip.setdefault(opened.pop(), set()).add(state)
        else:
            last = state + int(mark[2])
            for s in range(state, last):
                any_word[s] = s + 1
                skip.setdefault(s, set()).add(last)
            state = last
    if opened or not required:
        raise ValueError("an open region, or no wording that must stand")
    rarest = max(required, key=len)
    return Automaton(step, any_word, {s: tuple(t) for s, t in skip.items()}, state, rarest)


class Scanner:
    def __init__(self, templates: dict[str, str], base: tuple[tuple[str, str], ...]):
        self.automata = {label: compile_template(t) for label, t in templates.items()}
        self.base = [(tuple(words(phrase.encode())), label) for phrase, label in base]
        needed = {a.required for a in self.automata.values()}
        needed |= {max(phrase, key=len) for phrase, _ in self.base}
        self.needed = re.compile(b"|".join(map(re.escape, sorted(needed))))

    def scan(self, text: bytes):
        """Places of base phrases, and accepted places as (start, end, label)."""
        lowered = text.translate(LOWER.tobytes())
        if not self.needed.search(lowered):
            return [], []
        found = words(lowered)
        where: dict[bytes, list[int]] = {}
        for at, word in enumerate(found):
            where.setdefault(word, []).append(at)
        base = sorted(
            (at, at + len(phrase), label)
            for phrase, label in self.base
            for at in where.get(phrase[0], ())
            if tuple(found[at : at + len(phrase)]) == phrase
        )
        accepted = []
        for label, automaton in self.automata.items():
            if automaton.required not in where:
                continue
            firsts = automaton.starts()
            starts = (
                range(len(found))
                if firsts is None
                else sorted(at for word in firsts for at in where.get(word, ()))
            )
            for start in starts:
                end = automaton.accept(found, start)
                if end is not None:
                    accepted.append((start, end, label))
        return base, accepted


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...], base) -> Scanner:
    return Scanner(dict(templates), base)


def license_scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    base: tuple[tuple[str, str], ...] = BASE,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: ``key``, ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels``, ``score``, ``spans`` (``start``, ``end``, ``label``).

    ``labels`` are those of base phrases and of accepted templates; ``spans`` lists both.
    ``score`` is the share of words they cover. NULL is the empty text; it has no words, empty
    labels and score 0. Repeated keys give a row each; other columns are not read.
    """
    chosen = tuple((TEMPLATES if templates is None else templates).items())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = _scanner(chosen, base)
        data, offsets = text_bytes(batch.column(1))
        starts, _, first = word_spans(LOWER[data], offsets, WORD)
        counts = np.diff(first)
        raw = data.tobytes()
        rows = []
        for i, n_words in enumerate(counts.tolist()):
            found, accepted = scanner.scan(raw[offsets[i] : offsets[i + 1]])
            spans = sorted({*found, *accepted})
            covered, reached = 0, 0
            for start, end, _ in spans:
                covered += max(0, end - max(start, reached))
                reached = max(reached, end)
            rows.append(
                {
                    "n_words": n_words,
                    "n_base": len(found),
                    "first_word": found[0][0] if found else None,
                    "last_word": found[-1][0] if found else None,
                    "base_labels": ",".join(sorted({s[2] for s in found})),
                    "labels": ",".join(sorted({s[2] for s in spans})),
                    "score": covered / n_words if n_words else 0.0,
                    "spans": [{"start": a, "end": b, "label": c} for a, b, c in spans],
                }
            )
        columns = pa.Table.from_pylist(rows, _RESULT).combine_chunks().to_batches()
        if not columns:
            return pa.RecordBatch.from_pylist([], pa.schema([batch.schema.field(0), *_RESULT]))
        return columns[0].add_column(0, "key", batch.column(0))

    kind = docs.schema[key].dataType.simpleString()
    read = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    schema = (
        f"key {kind}, n_words long, n_base long, first_word long, last_word long,"
        " base_labels string, labels string, score double,"
        " spans array<struct<start: long, end: long, label: string>>"
    )
    return map_blocks(read, schema, run).withColumnRenamed("key", key)


_RESULT = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        (
            "spans",
            pa.list_(
                pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
            ),
        ),
    ]
)
