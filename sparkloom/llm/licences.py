"""Licence scans: Aho-Corasick over notice phrases and tags, shunting-yard over licence expressions.

Defined results: null or empty text has no words, no labels and score 0; repeated
rows each give a row; a null doc_id is kept as it is; an expression ends at the end of its line or where prose begins, and one
that does not parse adds the label `unparsed` and nothing else. Work grows with the length of a text, however many phrases it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.common import WORD_BYTES, field, fold_words, map_texts

# Phrases whose words must stand consecutively, and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Further notices.
NOTICE_PHRASES = {
    "apache license": "apache",
    "apache software license": "apache",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "bsd style license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "eclipse public license": "epl",
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "isc license": "isc",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "this is free and unencumbered software": "unlicense",
    "proprietary and confidential": "proprietary",
}
# Fixed value: the words of the machine-readable tag.
TAG_PHRASE = "spdx license identifier"
# How much a licence asks of a user, from 0 (nothing) to 1 (no use at all).
RESTRICTION = {
    "cc0": 0.05,
    "public-domain": 0.05,
    "unlicense": 0.05,
    "0bsd": 0.05,
    "mit": 0.1,
    "isc": 0.1,
    "bsd": 0.15,
    "bsl": 0.15,
    "apache": 0.2,
    "cc-by": 0.3,
    "mpl": 0.45,
    "epl": 0.45,
    "lgpl": 0.5,
    "cc-by-sa": 0.55,
    "cc-by-nd": 0.6,
    "gpl": 0.7,
    "agpl": 0.8,
    "cc-by-nc": 0.85,
    "proprietary": 1.0,
    "reserved": 1.0,
}
UNKNOWN_RESTRICTION = 0.5
#: What an exception granted by `with` takes off.
EXCEPTION_RELIEF = 0.1

# Identifiers without a version, and the tag's words for "no licence" and "not looked at", which label nothing.
PLAIN_IDENTIFIERS = ("0BSD", "Beerware", "Libpng", "NTP", "OpenSSL", "PostgreSQL", "Ruby", "Unlicense", "Vim", "WTFPL", "X11", "Zlib", "curl")
NO_LICENCE = ("NONE", "NOASSERTION")
#: Letters, then parts of which one is a version, as in BSD-3-Clause; or a licence of one's own; or an exception.
_VERSIONED = re.compile(r"[A-Za-z][A-Za-z0-9.]*(-[A-Za-z0-9.]+)*-v?[0-9]+(\.[0-9]+)*(-[A-Za-z0-9.]+)*\+?|(LicenseRef|DocumentRef)-[A-Za-z0-9.:-]+|[A-Za-z0-9.-]+-exception")
_VALUE = re.compile(rb"[ \t]*:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:\-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Expression:
    labels: frozenset[str]
    restriction: float


def family(identifier: str) -> str:
    """The label of a licence identifier: its family where known, else the identifier in lower case."""
    name = identifier.lower()
    for label in sorted(RESTRICTION, key=len, reverse=True):
        if name == label or name.startswith((label + "-", label + "+")):
            return label
    return name.replace(",", "")


def is_identifier(token: str) -> bool:
    """Whether a token is a licence identifier: a known one or one with a version. Capitals, digits or hyphens alone are prose."""
    label = family(token)
    known = label in RESTRICTION and label != "reserved"
    return known or token in PLAIN_IDENTIFIERS or token in NO_LICENCE or _VERSIONED.fullmatch(token) is not None


def to_postfix(tokens: Iterable[str]) -> list[str] | None:
    """Shunting-yard. Reads the longest prefix that alternates operands and operators; None if it is no expression."""
    out: list[str] = []
    stack: list[str] = []
    wants_operand = True
    for token in tokens:
        low = token.lower()
        if wants_operand:
            if token == "(":
                stack.append(token)
            elif not (token == ")" or low in _RANK) and is_identifier(token):
                out.append(token)
                wants_operand = False
            elif out and "(" not in stack:
                stack.pop()  # the operator before the prose belongs to it
                wants_operand = False
                break
            else:
                return None
        elif low in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            wants_operand = True
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        else:
            break  # prose after the expression
    if wants_operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(text: str) -> Expression | None:
    """`and` asks for both sides, `or` for the milder one, `with` relaxes its licence."""
    postfix = to_postfix(m[0] for m in _TOKEN.finditer(text))
    if postfix is None:
        return None
    stack: list[Expression] = []
    for token in postfix:
        if token not in _RANK:
            label = family(token)
            if token in NO_LICENCE:
                stack.append(Expression(frozenset(), UNKNOWN_RESTRICTION))
                continue
            stack.append(Expression(frozenset([label]), RESTRICTION.get(label, UNKNOWN_RESTRICTION)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(Expression(left.labels, max(0.0, left.restriction - EXCEPTION_RELIEF)))
        else:
            pick = min if token == "or" else max
            stack.append(Expression(left.labels | right.labels, pick(left.restriction, right.restriction)))
    return stack[0]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for base, phrases in ((True, BASE_PHRASES), (False, NOTICE_PHRASES), (None, {TAG_PHRASE: ""})):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (base, label, len(phrase) + 2))
    found.make_automaton()
    return found


def _tag_values(text: bytes, tags: set[int]) -> list[str]:
    """What follows each tag, by the number of its first word, in the original text: a colon and the rest of the line."""
    out = []
    last = max(tags) + 2
    spans: list[tuple[int, int]] = []
    for i, m in enumerate(WORD_BYTES.finditer(text)):
        spans = [*spans[-2:], m.span()]
        if i - 2 in tags and all(text[a[1] : b[0]] == b"-" for a, b in zip(spans, spans[1:])):
            value = _VALUE.match(text, m.end())
            if value:
                out.append(value[1].decode("utf-8", "replace").strip())
        if i >= last:
            break
    return out


def scan(text: bytes) -> tuple:
    """(words, base places, first, last, base labels, labels, score, expressions) of one text."""
    words = fold_words(text)
    line = f" {b' '.join(words).decode('latin-1')} " if words else ""
    base: set[str] = set()
    labels: set[str] = set()
    hits, tags = [], []  # places in the line of base phrases and of tags
    for end, (kind, label, length) in automaton().iter(line) if line else ():
        if kind is None:
            tags.append(end - length + 1)
        elif kind:
            hits.append(end - length + 1)
            base.add(label)
        else:
            labels.add(label)
    starts: list[int] = []
    expressions = []
    if hits or tags:
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        starts = np.searchsorted(blanks, hits).tolist()
        expressions = _tag_values(text, set(np.searchsorted(blanks, tags).tolist())) if tags else []
    asked = [RESTRICTION.get(x, UNKNOWN_RESTRICTION) for x in base | labels]
    labels |= base
    for source in expressions:
        value = evaluate(source)
        labels |= value.labels if value else {"unparsed"}
        asked.append(value.restriction if value else UNKNOWN_RESTRICTION)
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        max(asked, default=0.0),
        expressions,
    )


def licence_scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: places of base phrases, labels, how restrictive the text's licences are together, expressions."""
    fields = [
        field("n_words", "bigint"),
        field("n_base", "bigint"),
        field("first_word", "bigint"),
        field("last_word", "bigint"),
        field("base_labels", "string"),
        field("labels", "string"),
        field("score", "double"),
        field("expressions", "array<string>"),
    ]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]

    def make():
        return lambda texts: [
            pa.array(list(c), k) for c, k in zip(zip(*map(scan, texts)), kinds, strict=True)
        ] if texts else [pa.array([], k) for k in kinds]

    return map_texts(docs, [id_column], fields, make, text)
