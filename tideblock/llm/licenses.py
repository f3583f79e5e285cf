"""License scans: Aho-Corasick for notice phrases and identifier tags, and a shunting-yard parser for the tags' expressions.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; a phrase is
found where its words stand one after the other. Null and empty texts have no
words, no labels and score 0. Repeated rows each give a row. Whole texts are
scanned, whatever their length. A tag's expression ends where its line or the next
tag does, or where other words follow it; one that does not parse counts as a tag
without a valid expression.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bytes_of, sliced, words_of

#: Phrase -> label, fixed by the task.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases of the method's own, with the share of certainty that one place gives.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "boost software license": ("bsl", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons zero": ("cc0", 0.8),
    "bsd 2 clause": ("bsd", 0.8),
    "bsd 3 clause": ("bsd", 0.8),
    "bsd license": ("bsd", 0.8),
    "isc license": ("isc", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "released into the public domain": ("public-domain", 0.7),
    "all rights reserved": ("reserved", 0.5),
}
#: Names of licence families -> label; a version or the like may follow a name. And the labels whose works may be used freely.
FAMILIES = {
    "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "apache": "apache", "mit": "mit", "bsd": "bsd", "0bsd": "bsd", "mpl": "mpl", "epl": "epl", "bsl": "bsl", "isc": "isc", "zlib": "zlib", "artistic": "artistic", "ofl": "ofl", "ncsa": "ncsa", "cddl": "cddl", "eupl": "eupl",
    "postgresql": "postgresql", "python": "python", "psf": "python", "wtfpl": "wtfpl", "x11": "mit", "unlicense": "public-domain", "cc0": "cc0", "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc-by-nc-sa": "cc-by-nc-sa", "cc-by-nc-nd": "cc-by-nc-nd",
}
FREE = frozenset({"apache", "mit", "bsd", "bsl", "cc-by", "cc0", "isc", "zlib", "ncsa", "postgresql", "python", "wtfpl", "public-domain"})
#: What may follow a family's name in an identifier.
_AFTER = re.compile(r"(?:-?v?[0-9][a-z0-9.+-]*|\+|-only|-or-later)?")
TAG = "spdx license identifier"
_TAG = re.compile(rb"spdx-license-identifier\s*:[ \t]*((?:(?!spdx-license-identifier\s*:)[^\r\n])*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str]:
    """Tokens of a licence expression in postfix order: with binds tighter than and, and than or.

    >>> postfix("MIT OR (Apache-2.0 AND GPL-2.0 WITH Classpath-exception-2.0)")
    ['MIT', 'Apache-2.0', 'GPL-2.0', 'Classpath-exception-2.0', 'with', 'and', 'or']
    """
    tokens = _TOKEN.findall(expression)
    if not tokens:
        raise ValueError("no expression")
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # whether an operand is due
    for token in tokens:
        low = token.lower()
        if token == "(":
            if not operand:
                raise ValueError("operator missing")
            waiting.append(token)
        elif token == ")":
            if operand:
                raise ValueError("operand missing")
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError("closed but not opened")
            waiting.pop()
        elif low in _BINDS:
            if operand:
                raise ValueError("operand missing")
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = True
        else:
            if not operand:
                raise ValueError("operator missing")
            out.append(token)
            operand = False
    if operand or "(" in waiting:
        raise ValueError("unfinished")
    return out + waiting[::-1]


def leading(line: str) -> str:
    """The line as far as words can belong to one expression: up to where an operand stands, outside brackets, though an operator is due, or to a mark that no expression has.

    >>> leading("MIT OR (Apache-2.0) Copyright X")
    'MIT OR (Apache-2.0)'
    """
    operand, depth, end = True, 0, 0
    for m in _TOKEN.finditer(line):
        token = m[0].lower()
        if line[end : m.start()].strip() or not operand and not depth and token != ")" and token not in _BINDS:
            return line[:end]
        depth += (token == "(") - (token == ")")
        operand = token == "(" or token in _BINDS
        end = m.end()
    return line[:end]


def label_of(identifier: str) -> str:
    low = identifier.lower()
    name = max((x for x in FAMILIES if low.startswith(x) and _AFTER.fullmatch(low, len(x))), key=len, default=None)
    return FAMILIES[name] if name else "other"


def evaluate(expression: str, free: frozenset[str] = FREE) -> tuple[set[str], bool]:
    """Labels of an expression's licences, and whether they allow free use: or needs one side, and both; an exception changes nothing."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix(expression):
        if token in _BINDS:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append(left)
            else:
                stack.append((left[0] | right[0], left[1] or right[1] if token == "or" else left[1] and right[1]))
        else:
            label = label_of(token)
            stack.append(({label}, label in free))
    return stack[0]


_automaton = None


def automaton() -> ahocorasick.Automaton:
    """All phrases, each between spaces; built once for each worker."""
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for phrase in [*BASE, *NOTICES, TAG]:
            _automaton.add_word(f" {phrase} ", phrase)
        _automaton.make_automaton()
    return _automaton


def scan(text: bytes) -> dict:
    """Everything found in one text."""
    words = words_of(text)
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    n_base, first, last, base, labels, score, tags = 0, None, None, set(), set(), 0.0, 0
    at = word = 0  # word: how many start before character `at`
    for end, phrase in automaton().iter(line):
        if phrase == TAG:
            tags += 1
        elif phrase in NOTICES:
            label, sure = NOTICES[phrase]
            labels.add(label)
            score = max(score, sure)
        if phrase in BASE:
            start = end - len(phrase)  # its first character
            if start >= at:
                word += line.count(" ", at, start)
            else:
                word -= line.count(" ", start, at)
            at = start
            n_base += 1
            first, last = word - 1 if first is None else min(first, word - 1), max(last or 0, word - 1)
            base.add(BASE[phrase])
            score = max(score, 0.9)
    expressions, free = [], None
    if tags:
        for m in _TAG.finditer(text):
            said = m[1].decode("utf-8", "replace").split("*/")[0].split("-->")[0].strip()
            said = leading(said)
            try:
                found, allowed = evaluate(said)
            except ValueError:
                labels.add("other")
                score = max(score, 0.5)
                continue
            labels |= found
            free = allowed if free is None else free and allowed
            expressions.append(said)
            score = 1.0
    return {"n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": score, "expressions": expressions, "free": free}


_KINDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "expressions": pa.list_(pa.string()), "free": pa.bool_()}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and what scan() finds, for each row; `free` is null where no tag holds a valid expression."""

    def run(batches):
        for part in sliced(batches, text_col):
            rows = [scan(x) for x in bytes_of(part.column(text_col))]
            yield pa.RecordBatch.from_arrays([part.column(id_col), *(pa.array([r[k] for r in rows], kind) for k, kind in _KINDS.items())], [id_col, *_KINDS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, free boolean")
