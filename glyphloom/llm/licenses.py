"""Licence scans by sentence rules: sentences to identifiers, identifier sequences to licences.

A text's sentences, their lines joined, are normalised and looked up among known licence sentences. The
sequence of identifiers that a document holds is matched against ordered rules, each a run
of identifiers; the first rule that matches at a place names the licence and takes its
sentences, so a specific rule (a version with "or later") goes before a general one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame

from glyphloom.llm.common import arrow_rows

AS_PUBLISHED = r",?(?: as published by the free software foundation)?"
# Licence sentences by identifier, as patterns over normalised text (lower case, single
# spaces, no marks at the ends). A pattern has to cover the sentence's licence part, not the whole line.
SENTENCES = (
    ("spdx", r"spdx-license-identifier: (?P<id>[a-z0-9.+-]+(?: (?:or|and|with) [a-z0-9.+-]+)*)"),
    ("gpl_version_or_later", rf"(?:under the (?:terms of the )?)?gnu general public licen[sc]e{AS_PUBLISHED}[,;]? (?:either )?version (?P<id>[0-9.]+)(?: of the licen[sc]e)?,? or (?:\(at your option\) )?any later(?: version)?"),
    ("lgpl_version", rf"gnu (?:lesser|library) general public licen[sc]e{AS_PUBLISHED}[,;]? (?:either )?(?:version |v ?)(?P<id>[0-9.]+)"),
    ("agpl_version", rf"gnu affero general public licen[sc]e{AS_PUBLISHED}[,;]? (?:either )?(?:version |v ?)(?P<id>[0-9.]+)"),
    ("gpl_version", rf"gnu general public licen[sc]e{AS_PUBLISHED}[,;]? (?:either )?(?:version |v ?)(?P<id>[0-9.]+)"),
    ("apache_version", r"apache (?:software )?licen[sc]e,? (?:version |v)?(?P<id>[0-9.]+)"),
    ("mit_name", r"\bmit licen[sc]e"),
    ("mit_grant", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit_condition", r"the above copyright notice and this permission notice shall be included"),
    ("bsd_grant", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd_endorse", r"neither the name of (?:(?!neither the name of ).)* may be used to endorse or promote"),
    ("bsd_name", r"\b(?:new |modified |simplified )?bsd(?: (?P<id>[0-4])-clause)? licen[sc]e"),
    ("mpl_version", r"mozilla public licen[sc]e,? (?:version |v\. ?|v)?(?P<id>[0-9.]+)"),
    ("cc", r"(?:\bcc|creative commons)[ -](?P<id>by(?:[ -](?:nc|nd|sa))*)(?:[ -](?P<v>[0-9.]+))?"),
    ("cc_zero", r"\bcc0\b|creative commons zero|dedicated to the public domain"),
    ("public_domain", r"public domain"),
    ("isc_name", r"\bisc licen[sc]e"),
    ("unlicense", r"\bthe unlicense\b|unlicense\.org"),
    ("as_is", r"provided [\"“']?as is[\"”']?,? without warranty"),
    ("all_rights", r"all rights reserved"),
    ("copyright", r"(?:copyright|©|\(c\))"),
)
# Ordered rules (licence, kind, run of sentence identifiers). {id} and {v} come from the run's sentences.
RULES = (
    ("{id}", "declared", ("spdx",)),
    ("GPL-{id}-or-later", "copyleft", ("gpl_version_or_later",)),
    ("AGPL-{id}", "copyleft", ("agpl_version",)),
    ("LGPL-{id}", "copyleft", ("lgpl_version",)),
    ("GPL-{id}", "copyleft", ("gpl_version",)),
    ("Apache-{id}", "permissive", ("apache_version",)),
    ("BSD-3-Clause", "permissive", ("bsd_grant", "bsd_endorse")),
    ("BSD-2-Clause", "permissive", ("bsd_grant",)),
    ("BSD-{id}-Clause", "permissive", ("bsd_name",)),
    ("MIT", "permissive", ("mit_name", "mit_grant", "mit_condition", "as_is")),
    ("MIT", "permissive", ("mit_grant", "mit_condition", "as_is")),
    ("MIT", "permissive", ("mit_grant",)),
    ("MIT", "permissive", ("mit_name",)),
    ("MPL-{id}", "copyleft", ("mpl_version",)),
    ("CC-{id}-{v}", "creative commons", ("cc",)),
    ("CC0-1.0", "public domain", ("cc_zero",)),
    ("ISC", "permissive", ("isc_name",)),
    ("Unlicense", "public domain", ("unlicense",)),
    ("Public-Domain", "public domain", ("public_domain",)),
    ("All-Rights-Reserved", "restricted", ("copyright", "all_rights")),
    ("All-Rights-Reserved", "restricted", ("all_rights",)),
)
ANY_WORD = re.compile(r"(?i)licen[sc]e|copyright|©|\(c\)|spdx|redistribution|permission|warrant|public domain|creative commons|\bcc0?\b|rights reserved|endorse")
QUICK_WORDS = ("licen", "copyright", "©", "(c)", "spdx", "redistribution", "permission", "warrant", "public domain", "creative commons", "rights reserved", "endorse")
CC_WORD = re.compile(r"\bcc0?\b")
# What ends a sentence; a single line end doesn't.
END = re.compile(r"[.!?](?=\s|$)|\n[^\S\n]*\n|$")
MARGIN = re.compile(r"\s*(?:[*#/;!%]+|--+|-(?=\s))\s*")
"""Comment marks and bullets before a line's words."""
_PATTERNS = [(name, re.compile(pattern)) for name, pattern in SENTENCES]


def licence_sentences(text: str) -> Iterator[tuple[int, int, str, dict[str, str]]]:
    """(start, end, identifier, values) of known sentences, in text order; a sentence may wrap over lines.

    ``start`` is where the line with the sentence's licence part begins.
    """

    low = text.lower()
    if not any(word in low for word in QUICK_WORDS) and not CC_WORD.search(low):
        return
    start, end = 0, -1
    for m in ANY_WORD.finditer(text):
        if m.start() < end:
            continue
        at = max(end, 0)
        while True:  # past the ends of sentences without a licence word
            start, mark = at, END.search(text, at)
            if mark.end() > m.start() or mark.end() == at:
                break
            at = mark.end()
        end = END.search(text, m.end()).end()
        plain, begins, places = _joined(text, start, end)
        at, hits = 0, {}
        while at <= len(plain):  # a sentence may hold several licence parts, one after the other
            for order, (name, p) in enumerate(_PATTERNS):
                if order not in hits or (hits[order] and hits[order].start() < at):
                    hits[order] = _first_line(p, plain, at, begins) if name == "copyright" else p.search(plain, at)
            found = [(h.start(), order) for order, h in hits.items() if h]
            if not found:
                break
            hit, name = hits[min(found)[1]], _PATTERNS[min(found)[1]][0]
            yield places[bisect_right(begins, hit.start()) - 1], end, name, {k: v for k, v in hit.groupdict().items() if v}
            at = max(hit.end(), at + 1)


def _joined(text: str, start: int, end: int) -> tuple[str, list[int], list[int]]:
    """A sentence in lower case with its lines joined, where each line begins in that, and where in ``text``."""

    parts, begins, places, size = [], [], [], 0
    for line in text[start:end].splitlines(keepends=True):
        m = MARGIN.match(line)
        words = " ".join(line[m.end() if m else 0 :].lower().split())
        words = words if parts else words.lstrip(" .,;:!*#/-")
        if words:
            begins.append(size)
            places.append(start + len(line) - len(line.lstrip()))
            parts.append(words)
            size += len(words) + 1
        start += len(line)
    return " ".join(parts).rstrip(" .,;:!*#/-"), begins or [0], places or [start]


def _first_line(pattern: re.Pattern, plain: str, at: int, begins: list[int]) -> re.Match | None:
    """The first match from ``at`` on that begins a line."""

    return next((m for k in range(bisect_left(begins, at), len(begins)) if (m := pattern.match(plain, begins[k]))), None)


def recognised(sentences: list[tuple[int, int, str, dict[str, str]]]) -> list[tuple[str, str, int, int]]:
    """(licence, kind, start, end): at each place the first rule whose run stands there."""

    names = [s[2] for s in sentences]
    at, out = 0, []
    while at < len(names):
        for licence, kind, run in RULES:
            if tuple(names[at : at + len(run)]) == run:
                values = {"id": "", "v": ""}
                for s in sentences[at : at + len(run)]:
                    values |= s[3]
                name = licence.format(id=_version(values["id"]), v=values["v"]).rstrip("-").replace("--", "-")
                out.append((name, kind, sentences[at][0], sentences[at + len(run) - 1][1]))
                at += len(run)
                break
        else:
            at += 1
    return out


def _version(value: str) -> str:
    value = value.strip(" .")
    return value.upper().replace(" ", "-") if not value[:1].isdigit() else value if "." in value else f"{value}.0"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per recognised licence: key, licence, kind, start and end of its text.

    A text that holds none gives no row; null and empty texts hold none. Whole texts are
    read, and only sentences that hold a licence word are normalised and looked up. Rows that
    repeat give their rows again. Nothing is shuffled.
    """

    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for part in slices:
            yield [(doc_id, *found) for doc_id, value in part if value for found in recognised(list(licence_sentences(value)))]

    return arrow_rows(docs, [key, text], f"`{key}` {dict(docs.dtypes)[key]}, licence string, kind string, start int, `end` int", rows)
