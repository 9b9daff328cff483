"""Licence scans.

One Aho-Corasick automaton finds notice phrases and the identifier tag's words
in a text's words, and where these are, a second one finds the tag itself in the
text's bytes; the expression from a tag to the end of its line is turned to
postfix form by a shunting yard and evaluated against the permitted licences.

Defined cases: null and empty texts have no words, no labels and the score 0;
texts of any length are scanned whole; a phrase inside a longer one counts as a
base place but adds no further label; malformed expressions keep the licences
they name and count as not permitted; several tags of a line each have their
expression, and what follows a complete expression is ignored; of two phrases that start alike the longer
labels; repeated rows give repeated rows; an empty table gives no row; columns
with clashing names are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import bounded, slices

# Phrases (as words) whose every place is counted.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further phrases, their labels and how surely they state a licence.
NOTICES = {
    "the mit license": ("mit", 0.8),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "licensed under the apache license": ("apache-2", 0.9),
    "gnu general public license": ("gpl", 0.9),
    "gnu general public license version 2": ("gpl-2", 0.95),
    "gnu general public license version 3": ("gpl-3", 0.95),
    "gnu gpl": ("gpl", 0.7),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.95),
    "isc license": ("isc", 0.8),
    "the unlicense": ("unlicense", 0.6),
    "released into the public domain": ("public-domain", 0.8),
    "cc0": ("cc0", 0.7),
    "cc by": ("cc-by", 0.7),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by nc sa": ("cc-by-nc-sa", 0.95),
    "cc by nc nd": ("cc-by-nc-nd", 0.95),
    "creative commons attribution": ("cc-by", 0.8),
    "all rights reserved": ("all-rights-reserved", 0.6),
}
TAG, TAG_AS_WRITTEN = "spdx license identifier", "spdx-license-identifier:"
# Identifiers (lower case) that permit use, modification and sale.
PERMITTED = frozenset("mit apache-2.0 bsd-2-clause bsd-3-clause isc 0bsd unlicense cc0-1.0 cc-by-4.0 zlib bsl-1.0".split())
# Labels of phrases that do not permit this.
RESTRICTED = frozenset("cc-by-nc cc-by-nd cc-by-nc-sa cc-by-nc-nd all-rights-reserved gpl gpl-2 gpl-3 agpl lgpl".split())
# Exceptions that make a licence count as permitted.
EXCEPTIONS = frozenset("classpath-exception-2.0 gcc-exception-3.1 llvm-exception".split())
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_REST = re.compile(rb"[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def postfix(expression: str) -> list[str] | None:
    """Shunting yard: the expression's tokens in postfix order, lower case;
    null if it is malformed. Text after a complete expression is ignored."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for token in (m.lower() for m in _TOKEN.findall(expression)):
        if operand:
            if token == "(":
                held.append(token)
            elif token == ")" or token in _PRECEDENCE:
                return None
            else:
                out.append(token)
                operand = False
        elif token in _PRECEDENCE:
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        else:
            break
    if operand or "(" in held:
        return None
    return out + held[::-1]


def permitted(order: list[str]) -> bool:
    """Whether an expression in postfix order can be met by permitted licences."""
    stack: list[tuple[str, bool]] = []
    for token in order:
        if token in _PRECEDENCE:
            (right, b), (left, a) = stack.pop(), stack.pop()
            value = a or b if token == "or" else a and b if token == "and" else a or right in EXCEPTIONS
            stack.append((left, value))
        else:
            stack.append((token, token.removesuffix("+") in PERMITTED))
    return stack[-1][1]


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def tags():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word(TAG_AS_WRITTEN, TAG_AS_WRITTEN)
    found.make_automaton()
    return found


def expressions(text: str) -> list[str]:
    """What stands after each tag, A-Z in any case, up to the end of its line."""
    data = text.encode("utf-8", "surrogatepass")
    ends = [end + 1 for end, _ in tags().iter(data.lower().decode("latin-1"))]  # a character a byte
    return [_REST.match(data, at)[1].decode("utf-8", "surrogatepass") for at in ends]


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score,
    expression and permitted of one text."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS)
    words = data.split()
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    places = [(end + 1 - len(phrase) - 2, phrase) for end, phrase in automaton().iter(joined)]
    if not places:
        return len(words), 0, None, None, "", "", 0.0, None, None
    spans = [(at, at + len(phrase) + 2, phrase) for at, phrase in places]
    base = [(at, phrase) for at, _, phrase in spans if phrase in BASE]
    starts, before, word = [], 0, 0
    for at, _ in sorted(base):
        word += joined.count(" ", before, at)
        before = at
        starts.append(word)
    base_labels = {BASE[phrase] for _, phrase in base}
    labels, doubt, verdicts = set(base_labels), 0.01 if base else 1.0, []
    reached = 0  # where the spans that start no later, longer ones first, end at most
    for a, b, phrase in sorted(spans, key=lambda s: (s[0], -s[1])):
        inside, reached = b <= reached, max(reached, b)
        if phrase in NOTICES and not inside:
            label, surely = NOTICES[phrase]
            labels.add(label)
            doubt *= 1 - surely
    verdicts += [label not in RESTRICTED for label in labels]
    first = None
    if any(phrase == TAG for _, _, phrase in spans):
        for expression in expressions(text or ""):
            order = postfix(expression)
            first = first or expression.strip()
            names = order if order else [m.lower() for m in _TOKEN.findall(expression) if m not in "()"][:1]
            labels.update(x for i, x in enumerate(names) if x not in _PRECEDENCE and x not in EXCEPTIONS)
            verdicts.append(bool(order) and permitted(order))
            doubt *= 0.01 if order else 0.5
    score = 1 - doubt if labels else 0.0
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, first, all(verdicts) if verdicts else None)


_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expression", pa.string()), ("permitted", pa.bool_())]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of words and base places, the first and
    last base place, labels, the sureness of a licence statement (score), the
    first tagged expression, and whether all statements permit use."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = list(zip(*map(scan, batch.column("text").to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(v, t) for v, (_, t) in zip(rows, _FIELDS, strict=True))], [key, *(n for n, _ in _FIELDS)])

    return bounded(docs).select(key, F.col(text).alias("text")).mapInArrow(
        run, f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression string, permitted boolean"
    )
