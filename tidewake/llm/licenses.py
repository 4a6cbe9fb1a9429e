"""Licence scan: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser reads tag expressions.

Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII; a phrase is found where its words stand
consecutively. Tags (``SPDX-License-Identifier: ...``) are found as phrases too; the expression behind one, up to the end
of its line, is read by shunting-yard into operands and operators (WITH binds before AND, AND before OR; brackets nest)
and evaluated against the permitted licences. An expression that does not parse is reported as such; its identifiers count.

Null and empty texts have no words, no places and no labels. All places count, also those in repeated lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewake.llm.common import texts_of

# The phrases that every scan counts, and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Further notice phrases, and their labels.
NOTICE_PHRASES = {
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "permission is hereby granted free of charge": "mit",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# First parts of identifiers, and their labels.
IDENTIFIERS = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "isc": "isc", "mpl": "mpl",
    "cc0": "public-domain", "unlicense": "public-domain", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by": "cc-by",
}
#: Labels that an expression may be met by.
PERMITTED = frozenset({"mit", "apache", "bsd", "isc", "public-domain", "cc-by"})
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDS = {"OR": 1, "AND": 2, "WITH": 3}


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Of phrases with a space on either side, as bytes read as Latin-1 (so places are bytes)."""
    own = ahocorasick.Automaton()
    for p in phrases:
        own.add_word(f" {p} ", p)
    own.make_automaton()
    return own


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split()


def label_of(identifier: str) -> str | None:
    """The label of an identifier such as GPL-2.0-only, by its longest known first part."""
    low = identifier.lower().rstrip("+")
    return next((IDENTIFIERS[k] for k in sorted(IDENTIFIERS, key=len, reverse=True) if low == k or low.startswith(k + "-")), None)


def postfix(expression: str) -> list[str]:
    """Operands and operators of a licence expression in postfix order; ValueError if it does not parse."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        op = token.upper() if token.upper() in _BINDS else None
        if token == "(":
            if not operand_next:
                raise ValueError(expression)
            held.append(token)
        elif token == ")":
            if operand_next:
                raise ValueError(expression)
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError(expression)
            held.pop()
        elif op:
            if operand_next:
                raise ValueError(expression)
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[op]:
                out.append(held.pop())
            held.append(op)
            operand_next = True
        else:
            if not operand_next:
                raise ValueError(expression)
            out.append(token)
            operand_next = False
    if operand_next:
        raise ValueError(expression)
    while held:
        if held[-1] == "(":
            raise ValueError(expression)
        out.append(held.pop())
    return out


def evaluate(expression: str, permitted: frozenset[str] = PERMITTED) -> tuple[bool, set[str]]:
    """Whether the expression can be met by permitted licences alone, and the labels it names. An exception after WITH only adds rights."""
    stack: list[tuple[bool, set[str]]] = []
    for token in postfix(expression):
        if token in _BINDS:
            right, left = stack.pop(), stack.pop()
            if token == "WITH":
                stack.append(left)
            else:
                stack.append(((left[0] and right[0]) if token == "AND" else (left[0] or right[0]), left[1] | right[1]))
        else:
            label = label_of(token)
            stack.append((label in permitted, {label} if label else set()))
    return stack[0]


def scan_text(text: str, machine: ahocorasick.Automaton) -> tuple:
    found = words(text)
    line = b" " + b" ".join(found) + b" "
    hits = [(end - len(p) - 1, p) for end, p in machine.iter(line.decode("latin-1"))]
    base_at, labels, base_labels, tags, allowed = [], set(), set(), [], True
    if hits:
        starts = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)  # the space before word i is the i-th
        at = np.searchsorted(starts, [h[0] for h in hits])
        for (_, phrase), place in zip(hits, at.tolist(), strict=True):
            if phrase in BASE_PHRASES:
                base_at.append(place)
                base_labels.add(BASE_PHRASES[phrase])
            elif phrase in NOTICE_PHRASES:
                labels.add(NOTICE_PHRASES[phrase])
        if any(p == TAG for _, p in hits):
            for m in _TAG_LINE.finditer(text):
                tags.append(m[1].strip())
                try:
                    ok, named = evaluate(m[1])
                except ValueError:
                    ok, named = False, {x for t in _TOKEN.findall(m[1]) if (x := label_of(t))}
                labels |= named
                allowed &= ok
    labels |= base_labels
    if not labels:
        score = 0.0
    elif tags:
        score = 1.0
    else:
        score = 1 - 0.5 ** (len(base_at) + 1)
    return (
        len(found), len(base_at), min(base_at, default=None), max(base_at, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score,
        tags, bool(tags) and allowed,
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions (array<string>), permitted.

    score: 1 with an identifier tag, else 1 - 0.5^(places + 1) with any label, 0 without. permitted: every tagged
    expression can be met by the permitted licences (false without one).
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permitted"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton([*BASE_PHRASES, *NOTICE_PHRASES, TAG])
        for b in batches:
            out = pd.DataFrame([scan_text(t, machine) for t in b["text"]], columns=names)
            out[["first_word", "last_word"]] = out[["first_word", "last_word"]].astype("Int64")
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return texts_of(docs).mapInPandas(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permitted boolean"
    )
