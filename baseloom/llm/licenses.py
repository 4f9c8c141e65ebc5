"""License scan: an Aho-Corasick automaton over words finds notices; identifier tags hold expressions.

Words are runs of digits, ASCII letters and non-ASCII characters, with A-Z in lower case. All notice phrases are
found in one pass over the words; the tag ``SPDX-License-Identifier`` is one of the phrases, and the expression after it
is read by a shunting-yard parser with the precedence WITH, AND, OR and evaluated: the identifiers become labels, and the
permission of the expression is that of the best OR branch and the worst AND part. Operands are licence identifiers (a listed
name or beginning, a name with a version, or LicenseRef-); an expression ends before a word that is none, and before an operator in small
letters that no identifier follows. So prose behind a tag gives no labels.

Defined cases: a null or empty text has no words, no place, no label and score 0. A malformed expression keeps the identifiers
it names and its permission is 0. Texts are scanned whole. Repeated rows are scanned each on its own; an empty
table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from baseloom.llm.registry import query, table

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TAG = "spdx license identifier"
# Notice phrases beyond the base: label, and how far the phrase alone shows a licence, 0 to 1.
NOTICES = {
    "apache license version 2 0": ("apache-2.0", 0.95),
    "apache license 2 0": ("apache-2.0", 0.9),
    "licensed under the apache license": ("apache", 0.9),
    "mit license": ("mit", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.95),
    "redistribution and use in source and binary forms": ("bsd", 0.95),
    "bsd license": ("bsd", 0.85),
    "isc license": ("isc", 0.85),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "boost software license": ("bsl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "gnu free documentation license": ("gfdl", 0.9),
    "creative commons attribution": ("cc-by", 0.9),
    "creative commons zero": ("cc0", 0.9),
    "cc0 1 0": ("cc0", 0.85),
    "cc by sa": ("cc-by-sa", 0.85),
    "cc by nc": ("cc-by-nc", 0.85),
    "cc by nd": ("cc-by-nd", 0.85),
    "cc by nc sa": ("cc-by-nc-sa", 0.85),
    "cc by nc nd": ("cc-by-nc-nd", 0.85),
    "dedicated to the public domain": ("public-domain", 0.85),
    "released into the public domain": ("public-domain", 0.85),
    "do what the fuck you want to public license": ("wtfpl", 0.9),
    "proprietary and confidential": ("proprietary", 0.85),
}
BASE_STRENGTH = {"cc by": 0.7, "general public license": 0.85, "all rights reserved": 0.6}
# Permission of an identifier by its beginning; the longest that fits counts, others have the last.
PERMISSION = {
    "mit": 1.0, "isc": 1.0, "bsd": 1.0, "apache": 1.0, "0bsd": 1.0, "unlicense": 1.0, "cc0": 1.0, "zlib": 1.0, "bsl": 1.0,
    "cc-by": 0.9, "cc-by-sa": 0.6, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "gpl": 0.3, "agpl": 0.2,
}
# Identifiers without a version in their name, beside the beginnings above.
NAMED = frozenset(
    "afmparse aladdin antlr-pd beerware blessing caldera copyleft curl cube diffmark dotseqn eurosym fair freeimage ftl glide glulxe hpnd ibm-pibs icu "
    "ijg imagemagick info-zip intel json jasper leptonica libpng libtiff linux-openib minpack miros motosoto multics mup naist nasa ncsa "
    "net-snmp netcdf newsletr ngpl nlpl noweb nrl openssl pddl php plexus postgresql psfrag psutils qhull rdisc ruby saxpath sendmail sissl "
    "sleepycat snia spencer swl tcl tcp-wrappers tosl vim vostrom w3c wsuipa wtfpl xerox xfig xnet xinetd xpp zed zend".split()
)
UNKNOWN = 0.0
WITH_BONUS = 0.2

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
# An expression ends at the latest where the line or the next tag begins; a line can hold many tags.
_TAGGED = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*((?:(?!spdx-license-identifier[ \t]*:)[^\r\n])*)", re.IGNORECASE)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_VERSIONED = re.compile(r"[a-z][a-z0-9.+]*(?:-[a-z0-9.+]+)*-v?[0-9]+(?:\.[0-9]+)*(?:[a-z+]|-[a-z0-9.+-]+)?")
_REFERENCE = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
_EXCEPTION = re.compile(r"[a-z0-9.+-]+-(?:exception|note)(?:-[a-z0-9.+-]+)?")
_ORDER = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=10_000)
def identifies(word: str, exception: bool = False) -> bool:
    """Whether a word in small letters names a licence, or an exception after WITH."""
    if exception:
        return bool(_EXCEPTION.fullmatch(word) or _VERSIONED.fullmatch(word) or _REFERENCE.fullmatch(word.replace("additionref-", "licenseref-")))
    listed = any(word == p or word.startswith((p + "-", p + "+")) for p in PERMISSION) or word in NAMED
    return bool(listed or _VERSIONED.fullmatch(word) or _REFERENCE.fullmatch(word))


def _tokens(text: str) -> list[str]:
    """Brackets and words up to the first other character."""
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m:
            out.append(m[0] if m[0] in "()" else m[0].rstrip(".:-"))
        elif text[at] not in " \t":
            break
        at = m.end() if m else at + 1
    return out


def parse(text: str) -> tuple[list[str], bool]:
    """An expression in postfix order, and whether it is well formed. Reading ends where the expression does.

    ``MIT OR (Apache-2.0 AND GPL-2.0 WITH Classpath-exception-2.0) */`` gives
    mit, apache-2.0, gpl-2.0, classpath-exception-2.0, with, and, or. ``MIT and see the file`` gives mit.
    """
    out: list[str] = []
    stack: list[str] = []
    good, operand = True, True
    read = _tokens(text)
    for at, token in enumerate(read):
        word = token.lower()
        if word in _ORDER and token in (word, word.upper()):
            if operand:
                good = False
                break
            after = read[at + 1].lower() if at + 1 < len(read) else ""
            if token == word and after and not (after == "(" and word != "with") and not identifies(after, word == "with"):
                break  # prose goes on after the expression
            while stack and stack[-1] != "(" and _ORDER[stack[-1]] >= _ORDER[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif word == "(":
            if not operand:
                break
            stack.append(word)
        elif word == ")":
            if "(" not in stack:
                break
            if operand:
                good = False
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif not operand or not identifies(word, bool(stack) and stack[-1] == "with"):
            break  # words after a whole expression, or no identifiers, are not part of it
        else:
            out.append(word)
            operand = False
    good = good and not operand and "(" not in stack
    if good:
        out.extend(reversed(stack))
    return out, good


@lru_cache(maxsize=10_000)
def permission_of(identifier: str) -> float:
    fits = [p for p in PERMISSION if identifier == p or identifier.startswith((p + "-", p + "+"))]
    return PERMISSION[max(fits, key=len)] if fits else UNKNOWN


def evaluate(text: str) -> tuple[list[str], float]:
    """Licences that an expression names, and its permission from 0 to 1."""
    postfix, good = parse(text)
    if not good:
        return sorted({t for t in postfix if t not in _ORDER}), 0.0
    stack: list[tuple[float, frozenset]] = []
    for token in postfix:
        if token not in _ORDER:
            stack.append((permission_of(token), frozenset([token])))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((min(1.0, a + WITH_BONUS), left))
        else:
            stack.append(((min if token == "and" else max)(a, b), left | right))
    return sorted(stack[-1][1]), stack[-1][0]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        machine.add_word(f" {phrase} ", phrase)
    machine.make_automaton()
    return machine


def scan(text: str | None) -> dict:
    """Words, base places, labels, score and permission of one text."""
    words = _WORD.findall((text or "").translate(_LOWER))
    joined = " " + " ".join(words) + " "
    places, found, strength, tagged = [], [], 0.0, False
    at = number = 0
    for end, phrase in sorted(_automaton().iter(joined), key=lambda m: m[0] - len(m[1])):
        begin = end - len(phrase) - 1
        number += joined.count(" ", at, begin)
        at = begin
        if phrase == TAG:
            tagged = True
            continue
        label, worth = NOTICES.get(phrase) or (BASE[phrase], BASE_STRENGTH[phrase])
        found.append((number, number + len(phrase.split(" ")), label))
        strength = max(strength, worth)
        if phrase in BASE:
            places.append((number, label))
    permission = None
    if tagged:
        for m in _TAGGED.finditer(text):
            names, value = evaluate(m[1])
            if names:
                found.extend((None, None, n) for n in names)
                permission = value if permission is None else min(permission, value)
                strength = 1.0
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": places[0][0] if places else None,
        "last_word": places[-1][0] if places else None,
        "base_labels": sorted({p[1] for p in places}),
        "labels": sorted({f[2] for f in found}),
        "score": strength,
        "permission": permission,
        "spans": [{"label": label, "start": s, "end": e} for s, e, label in found if s is not None],
    }


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_documents(documents: DataFrame) -> DataFrame:
    """doc_id with the results of ``scan``; spans are word ranges, ends exclusive."""
    types = {
        "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.list_(pa.string()),
        "labels": pa.list_(pa.string()), "score": pa.float64(), "permission": pa.float64(), "spans": _SPANS,
    }
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
        "labels array<string>, score double, permission double, spans array<struct<label:string,start:long,end:long>>"
    )

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [scan(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[n] for r in rows], t) for n, t in types.items())], names=["doc_id", *types])

    return documents.select("doc_id", "text").mapInArrow(run, schema)


@query("op7_licenses")
def op7_licenses(spark, d):
    from pyspark.sql import functions as F

    return scan_documents(table(spark, d, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", "permission",
    )
