"""License scans (operator 10): conditional compression against templates.

A block is a line.  A block is a candidate if it holds a cue: a word that
license notices use and prose hardly does.  A long candidate is read in
windows of words that overlap by half, so that a notice lies in one of them
whole.  The window is compressed alone and with every template as zstandard raw
dictionary; the bytes saved rank the templates.  In that order words confirm
them: a template's words are aligned with the window's, and the block carries the
license if at most ``max_diff`` of the template's words are missing or changed.  Words beyond
the template (a notice run on into prose) are counted but do not count against it.
The first template without a difference ends the window; while there is none, the
next ones are aligned too, as saved bytes are only a rank: in long lines an exact notice can
save none.  The bytes in the result are those of the window.

Edge cases: null text has no lines; a block that no template confirms gives no
row; a block that several confirm gives the best by differences, then by saved bytes,
then by name; repeated lines, rows and null ids give their own rows; extra
columns are ignored.

One Arrow pass without a shuffle; verdicts of repeated lines are kept in a
bounded table per task.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SCHEMA = ("doc_id long, line_no long, license string, plain_bytes int, conditional_bytes int, saved_bytes int, "
          "n_changed int, n_beyond int, exact boolean")

#: Short notices of public licenses.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "EPL-2.0": "Made available under the terms of the Eclipse Public License 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "Released into the public domain under the Unlicense.",
}
CUE = re.compile(r"licen[cs]|rights\s+reserved|public\s+domain|copyright|creative\s+commons|\bCC[\s-]?(?:BY|0)\b|"
                 r"\bGNU\b|\bapache\b|\bmozilla\b", re.I)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
CACHE_LINES, HALF_WINDOW = 50_000, 64


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, max_diff: float = 0.15, level: int = 3):
        plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.plain = lambda raw: len(plain.compress(raw))
        self.max_diff = max_diff
        self.templates = []
        for name, text in sorted(templates.items()):
            raw = text.encode()
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            pack = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False)
            self.templates.append((name, words(text), pack))
        self.half = max(HALF_WINDOW, 2 * max((len(tw) for _, tw, _ in self.templates), default=0))
        self.seen: dict[str, tuple | None] = {}

    def __call__(self, line: str) -> tuple | None:
        """(license, plain, conditional, saved, changed, beyond, exact) of a line."""
        if not CUE.search(line):
            return None
        if line not in self.seen:
            if len(self.seen) >= CACHE_LINES:
                self.seen.clear()
            self.seen[line] = self._scan(line)
        return self.seen[line]

    def windows(self, line: str):
        """(text, words, words of the line outside it); all of the line is in one at least."""
        found = list(_WORD.finditer(line))
        if len(found) <= 2 * self.half:
            yield line, [m[0].lower() for m in found], 0
            return
        for k in range(0, len(found) - self.half, self.half):
            part = found[k:k + 2 * self.half]
            yield line[part[0].start():part[-1].end()], [m[0].lower() for m in part], len(found) - len(part)

    def ranked(self, raw: bytes, alone: int) -> list[tuple[int, str, list[str], int]]:
        """(bytes lost, license, its words, bytes with it) of all templates, the one that saves most first."""
        sizes = [(name, tw, len(pack.compress(raw))) for name, tw, pack in self.templates]
        return sorted((with_it - alone, name, tw, with_it) for name, tw, with_it in sizes)

    def _scan(self, line: str) -> tuple | None:
        best = None
        for text, block, outside in self.windows(line):
            own, raw = set(block), text.encode("utf-8", "surrogatepass")
            alone = self.plain(raw)
            for lost, name, tw, with_it in self.ranked(raw, alone):
                # words that the window lacks are changed for certain
                if not tw or sum(w not in own for w in tw) > self.max_diff * len(tw):
                    continue
                changed, beyond = differences(tw, block)
                if changed > self.max_diff * len(tw):
                    continue
                got = (changed, lost, name, with_it, beyond + outside, alone)
                best = got if best is None or got < best else best
                if not changed:
                    break       # exact, and all others save less
        if best is None:
            return None
        changed, lost, name, with_it, beyond, alone = best
        return name, alone, with_it, -lost, changed, beyond, changed == 0


def differences(template: list[str], block: list[str]) -> tuple[int, int]:
    """(template words missing or changed, or words put in between; block words outside
    the template's stretch)."""
    if not template:
        return 0, len(block)
    runs = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not runs:
        return len(template), len(block)
    # the densest chain of runs: start from the longest, take neighbours that lie close
    k = max(range(len(runs)), key=lambda i: runs[i].size)
    lo = hi = k
    while lo and runs[lo].b - (runs[lo - 1].b + runs[lo - 1].size) <= 2:
        lo -= 1
    while hi + 1 < len(runs) and runs[hi + 1].b - (runs[hi].b + runs[hi].size) <= 2:
        hi += 1
    used = sum(r.size for r in runs[lo:hi + 1])
    stretch = runs[hi].b + runs[hi].size - runs[lo].b
    return max(len(template), stretch) - used, len(block) - stretch


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, max_diff: float = 0.15) -> DataFrame:
    """One row per line that carries a license notice."""
    def run(batches):
        scan = Scanner(templates, max_diff)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text and CUE.search(text):
                    out += [(doc_id, i, *hit) for i, line in enumerate(text.split("\n")) if (hit := scan(line))]
            cols = list(zip(*out)) or [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
