"""License scans: Aho-Corasick over words for notices, over text for identifier tags, then SPDX expressions.

Words are maximal runs of 0-9, a-z (after A-Z are lower-cased) and non-ASCII characters. One automaton finds all
phrases on the words, overlapping ones included; a phrase counts where its words stand consecutively.
A second automaton finds ``spdx-license-identifier:`` tags; the expression behind a tag goes through a
shunting-yard parser with the operators ``with`` > ``and`` > ``or`` and is evaluated to the licenses it names and to
whether a permissive choice satisfies it. Identifiers are those of the tables below, exactly; any other one is not permissive
and gets the label ``spdx-custom`` or ``spdx-unknown``. A malformed expression contributes the label ``spdx-invalid``.
Work is linear in the text, however many notices, tags or operands it holds.

Score, 0 to 1: 1 - product of (1 - weight) over the distinct labels found, by notice phrase or by expression.

Defined results: a null text counts as empty (no words, no labels, score 0); repeated rows are kept; texts of any
length are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Phrase → label of the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices, and the statements that reserve rights.
MORE = {
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "creative commons": "cc",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx-license-identifier:"
#: Evidence of one label.
WEIGHT = {"proprietary": 0.3, "public-domain": 0.4, "cc": 0.5, "spdx-invalid": 0.2, "spdx-unknown": 0.2, "spdx-permissive": 0.5, "spdx-restrictive": 0.5}
#: SPDX identifiers (lower-cased) whose terms are permissive → label.
PERMISSIVE = {
    "0bsd": "bsd", "afl-3.0": "afl", "apache-1.1": "apache", "apache-2.0": "apache", "artistic-2.0": "artistic", "blueoak-1.0.0": "blueoak",
    "bsd-1-clause": "bsd", "bsd-2-clause": "bsd", "bsd-2-clause-patent": "bsd", "bsd-3-clause": "bsd", "bsd-3-clause-clear": "bsd", "bsd-4-clause": "bsd",
    "bsl-1.0": "bsl", "cc-by-3.0": "cc", "cc-by-4.0": "cc", "cc0-1.0": "cc", "curl": "curl", "ecl-2.0": "ecl", "ftl": "ftl", "hpnd": "hpnd", "isc": "isc",
    "libpng": "libpng", "libpng-2.0": "libpng", "mit": "mit", "mit-0": "mit", "ms-pl": "ms-pl", "ncsa": "ncsa", "openssl": "openssl", "php-3.01": "php",
    "postgresql": "postgresql", "psf-2.0": "psf", "python-2.0": "psf", "ruby": "ruby", "unicode-3.0": "unicode", "unicode-dfs-2016": "unicode",
    "unlicense": "unlicense", "upl-1.0": "upl", "w3c": "w3c", "wtfpl": "wtfpl", "x11": "x11", "zlib": "zlib", "zpl-2.1": "zpl",
}
#: SPDX identifiers with conditions on derived works → label.
RESTRICTIVE = {
    "agpl-1.0": "agpl", "agpl-3.0": "agpl", "agpl-3.0-only": "agpl", "agpl-3.0-or-later": "agpl", "apsl-2.0": "apsl", "busl-1.1": "busl",
    "cc-by-nc-4.0": "cc", "cc-by-nc-nd-4.0": "cc", "cc-by-nc-sa-4.0": "cc", "cc-by-nd-4.0": "cc", "cc-by-sa-3.0": "cc", "cc-by-sa-4.0": "cc",
    "cddl-1.0": "cddl", "cddl-1.1": "cddl", "cecill-2.1": "cecill", "cpl-1.0": "cpl", "epl-1.0": "epl", "epl-2.0": "epl", "eupl-1.1": "eupl", "eupl-1.2": "eupl",
    "gfdl-1.3": "gfdl", "gfdl-1.3-only": "gfdl", "gfdl-1.3-or-later": "gfdl", "gpl-1.0": "gpl", "gpl-2.0": "gpl", "gpl-2.0-only": "gpl", "gpl-2.0-or-later": "gpl",
    "gpl-3.0": "gpl", "gpl-3.0-only": "gpl", "gpl-3.0-or-later": "gpl", "lgpl-2.0": "lgpl", "lgpl-2.0-only": "lgpl", "lgpl-2.0-or-later": "lgpl",
    "lgpl-2.1": "lgpl", "lgpl-2.1-only": "lgpl", "lgpl-2.1-or-later": "lgpl", "lgpl-3.0": "lgpl", "lgpl-3.0-only": "lgpl", "lgpl-3.0-or-later": "lgpl",
    "mpl-1.1": "mpl", "mpl-2.0": "mpl", "ms-rl": "ms-rl", "odbl-1.0": "odbl", "ofl-1.1": "ofl", "osl-3.0": "osl", "qpl-1.0": "qpl", "sspl-1.0": "sspl",
}
#: Labels of identifiers that are in neither table: ``LicenseRef-...`` ones, and all others.
CUSTOM, UNKNOWN = "spdx-custom", "spdx-unknown"
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_SPACED = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_EXPRESSION = re.compile(r"[ \t]*([A-Za-z0-9.+\-]+|\(|\))")


def tokenize_expression(text: str, at: int) -> list[str]:
    """Identifiers, operators and parentheses from ``at`` to the end of the line; stops where two operands meet."""
    out: list[str] = []
    while m := _EXPRESSION.match(text, at):
        token = m[1]
        operand = token != ")" and token.lower() not in PRECEDENCE
        closed = out and out[-1] != "(" and out[-1].lower() not in PRECEDENCE
        if operand and closed:
            break
        out.append(token)
        at = m.end()
    return out


def shunting_yard(tokens: list[str]) -> list[str] | None:
    """Postfix order, or None if the expression is malformed."""
    output: list[str] = []
    pending: list[str] = []
    want_operand = True
    for token in tokens:
        low = token.lower()
        if token == "(":
            if not want_operand:
                return None
            pending.append(token)
        elif token == ")":
            if want_operand:
                return None
            while pending and pending[-1] != "(":
                output.append(pending.pop())
            if not pending:
                return None
            pending.pop()
        elif low in PRECEDENCE:
            if want_operand:
                return None
            while pending and pending[-1] != "(" and PRECEDENCE[pending[-1]] >= PRECEDENCE[low]:
                output.append(pending.pop())
            pending.append(low)
            want_operand = True
        else:
            if not want_operand:
                return None
            output.append(token)
            want_operand = False
    if want_operand or "(" in pending:
        return None
    return output + pending[::-1]


def evaluate(postfix: list[str]) -> tuple[list[str], bool]:
    """Labels of the licenses named, and whether a choice among permissive ones satisfies the expression."""
    named: list[str] = []
    stack: list[tuple[int, bool]] = []  # where an operand's labels begin, and whether it is permissive
    for token in postfix:
        if token in PRECEDENCE:
            (begin, b), (first, a) = stack.pop(), stack.pop()
            if token == "with":  # an exception only widens what its license permits
                del named[begin:]
                stack.append((first, a))
            else:
                stack.append((first, a or b if token == "or" else a and b))
        else:
            low = token.lower().rstrip("+")
            stack.append((len(named), low in PERMISSIVE))
            named.append(PERMISSIVE.get(low) or RESTRICTIVE.get(low) or (CUSTOM if low.startswith("licenseref-") else UNKNOWN))
    return named, stack[0][1]


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, more: dict[str, str] = MORE):
        self.phrases = ahocorasick.Automaton()
        for phrase in {*base, *more}:
            self.phrases.add_word(f" {phrase} ", (phrase.count(" ") + 1, base.get(phrase), more.get(phrase, base.get(phrase))))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        self.tags.add_word(TAG, TAG)
        self.tags.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, labels, score."""
        low = (text or "").encode("utf-8", "surrogatepass").lower()
        words = low.translate(_SPACED).split()
        line = f" {b' '.join(words).decode('latin-1')} "
        base, labels, first, last, n_base = set(), set(), None, None, 0
        before, upto = 0, 0  # words that end before ``upto``, plus one; matches come in order of their ends
        for end, (size, label, other) in self.phrases.iter(line):
            labels.add(other)
            if label is not None:
                before, upto = before + line.count(" ", upto, end), end
                at = before - size  # the match ends at the blank behind its last word
                first = at if first is None else min(first, at)
                last = at if last is None else max(last, at)
                n_base += 1
                base.add(label)
        if b"spdx-license-identifier:" in low:
            shown = low.decode("latin-1")
            for end, _ in self.tags.iter(shown):
                postfix = shunting_yard(tokenize_expression(shown, end + 1))
                if postfix is None:
                    labels.add("spdx-invalid")
                else:
                    named, permissive = evaluate(postfix)
                    labels.update(named)
                    labels.add("spdx-permissive" if permissive else "spdx-restrictive")
        labels |= base
        doubt = 1.0
        for label in sorted(labels):
            doubt *= 1 - WEIGHT.get(label, 0.8)
        return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - doubt


def scan_licenses(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        names = [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            rows = list(zip(*[scanner.scan(t.as_py()) for t in batch.column(text)], strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(c, t) for c, t in zip(rows, types, strict=True)]], names=names)

    body = documents.select(key, text)
    kind = body.schema[key].dataType.simpleString()
    return body.mapInArrow(run, f"`{key}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")


def op5_licenses(documents: DataFrame) -> DataFrame:
    return scan_licenses(documents)
