"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by containment.

Every rule is a regular expression for one way to name a license, with a
priority, a weight and keywords, one of which any match contains once its white
space runs are folded to one blank. One Aho-Corasick automaton finds the
keywords of a folded text in one pass; only the rules of keywords that occur
are run, on the text as it is, in the order of their priority. A detection is suppressed
if its interval lies inside that of a detection of higher priority, or of a
longer one of the same priority. Rules of the base phrases are never
suppressed.

Rules come from a list of licenses (name, pattern, keyword, versions) times a
list of forms: the name with and without a version, a tag, a grant sentence
and a reference to a file or address; and from sentences of the licenses' own
texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from corroborate.llm.common import add_columns, term_spans, terms

# Phrases and labels of the base rules.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, pattern of the name (in lower case; a blank is any white space), keyword, versions.
FAMILIES = (
    ("gpl", r"gnu (?:general public|gpl) licen[cs]e|gnu gpl|gpl", "gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", r"gnu (?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl", "gpl", ("2.0", "2.1", "3.0")),
    ("agpl", r"gnu affero general public licen[cs]e|gnu agpl|agpl", "gpl", ("1.0", "3.0")),
    ("gfdl", r"gnu free documentation licen[cs]e|gfdl", "gnu", ("1.1", "1.2", "1.3")),
    ("apache", r"apache(?: software)? licen[cs]e", "apache", ("1.0", "1.1", "2.0")),
    ("mit", r"(?:mit|expat|x11) licen[cs]e", "licen", ()),
    ("mit-0", r"mit no attribution(?: licen[cs]e)?", "no attribution", ()),
    ("bsd-2-clause", r"bsd[ -](?:2|two)[ -]clause(?: licen[cs]e)?|simplified bsd licen[cs]e|freebsd licen[cs]e", "bsd", ()),
    ("bsd-3-clause", r"bsd[ -](?:3|three)[ -]clause(?: licen[cs]e)?|(?:new|revised|modified) bsd licen[cs]e", "bsd", ()),
    ("bsd-4-clause", r"bsd[ -](?:4|four)[ -]clause(?: licen[cs]e)?|original bsd licen[cs]e", "bsd", ()),
    ("0bsd", r"(?:zero|0)[ -]clause bsd(?: licen[cs]e)?|0bsd", "bsd", ()),
    ("bsd", r"bsd licen[cs]e", "bsd", ()),
    ("mpl", r"mozilla public licen[cs]e", "mozilla", ("1.0", "1.1", "2.0")),
    ("epl", r"eclipse public licen[cs]e", "eclipse", ("1.0", "2.0")),
    ("cddl", r"common development and distribution licen[cs]e|cddl", "c", ("1.0", "1.1")),
    ("cpl", r"common public licen[cs]e", "common public", ("1.0",)),
    ("ipl", r"ibm public licen[cs]e", "ibm", ("1.0",)),
    ("eupl", r"european union public licen[cs]e|eupl", "eu", ("1.0", "1.1", "1.2")),
    ("artistic", r"artistic licen[cs]e", "artistic", ("1.0", "2.0")),
    ("isc", r"isc licen[cs]e", "isc", ()),
    ("zlib", r"zlib(?:/libpng)? licen[cs]e", "zlib", ()),
    ("bsl", r"boost software licen[cs]e", "boost", ("1.0",)),
    ("unlicense", r"the unlicense", "unlicense", ()),
    ("wtfpl", r"wtfpl|do what the fuck you want to public licen[cs]e", "wtf", ("1.0", "2.0")),
    ("beerware", r"beer-?ware licen[cs]e", "beer", ()),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", ()),
    ("python", r"python(?: software foundation)? licen[cs]e", "python", ("2.0",)),
    ("ruby", r"ruby licen[cs]e", "ruby", ()),
    ("php", r"php licen[cs]e", "php", ("3.0", "3.01")),
    ("zpl", r"zope public licen[cs]e", "zope", ("1.1", "2.0", "2.1")),
    ("w3c", r"w3c software(?: notice and)? licen[cs]e", "w3c", ()),
    ("openssl", r"openssl licen[cs]e", "openssl", ()),
    ("ncsa", r"(?:university of illinois/)?ncsa open source licen[cs]e", "ncsa", ()),
    ("upl", r"universal permissive licen[cs]e", "universal permissive", ("1.0",)),
    ("ms-pl", r"microsoft public licen[cs]e", "microsoft", ()),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", "microsoft", ()),
    ("osl", r"open software licen[cs]e", "open software", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", r"academic free licen[cs]e", "academic", ("1.1", "2.0", "2.1", "3.0")),
    ("ofl", r"(?:sil )?open font licen[cs]e", "open font", ("1.0", "1.1")),
    ("lppl", r"latex project public licen[cs]e|lppl", "l", ("1.0", "1.1", "1.2", "1.3c")),
    ("cecill", r"cecill(?: free software)? licen[cs]e", "cecill", ("1.0", "2.0", "2.1")),
    ("vim", r"vim licen[cs]e", "vim", ()),
    ("sleepycat", r"sleepycat licen[cs]e", "sleepycat", ()),
    ("imagemagick", r"imagemagick licen[cs]e", "imagemagick", ()),
    ("curl", r"curl licen[cs]e", "curl", ()),
    ("qpl", r"q public licen[cs]e", "q public", ("1.0",)),
    ("apsl", r"apple public source licen[cs]e", "apple", ("1.0", "1.1", "1.2", "2.0")),
    ("rpl", r"reciprocal public licen[cs]e", "reciprocal", ("1.1", "1.5")),
    ("sspl", r"server side public licen[cs]e", "server side", ("1.0",)),
    ("busl", r"business source licen[cs]e", "business source", ("1.1",)),
    ("elastic", r"elastic licen[cs]e", "elastic", ("2.0",)),
    ("mulan-psl", r"mulan permissive software licen[cs]e", "mulan", ("1.0", "2.0")),
    ("odbl", r"open database licen[cs]e|odbl", "od", ("1.0",)),
    ("odc-by", r"open data commons attribution licen[cs]e", "open data commons", ("1.0",)),
    ("pddl", r"public domain dedication and licen[cs]e", "public domain", ("1.0",)),
    ("cc0", r"cc0|creative commons zero", "c", ("1.0",)),
    ("cc-by", r"(?:cc|creative commons)[ -](?:by|attribution)(?![ -](?:sa|nc|nd|share|non))", "c", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:sa|share-?alike)", "c", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:nc|non-?commercial)(?![ -](?:sa|nd|share|no))", "c", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:nd|no-?deriv\w*)", "c", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:nc|non-?commercial)[ -](?:sa|share-?alike)", "c", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-nd", r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:nc|non-?commercial)[ -](?:nd|no-?deriv\w*)", "c", ("1.0", "2.0", "2.5", "3.0", "4.0")),
)
# Keywords of families whose names have no longer common part, one for each alternative.
KEYWORDS = {
    "gpl": ("gnu", "gpl"),
    "gfdl": ("gnu", "gfdl"),
    "wtfpl": ("wtfpl", "do what the fuck"),
    "cddl": ("common development", "cddl"),
    "cc0": ("cc0", "creative commons"),
    "lppl": ("latex project", "lppl"),
    "eupl": ("european union", "eupl"),
    "odbl": ("open database", "odbl"),
    "lgpl": ("gnu", "lgpl"),
    "agpl": ("gnu", "agpl"),
} | {name: ("cc", "creative") for name, *_ in FAMILIES if name.startswith("cc-by")}

# Label, typical sentence of a license's own text (a blank is any break between words), keyword.
_FREE = "permission is hereby granted free of charge"
_ANY_USE = "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"
SENTENCES = (
    ("mit", f"{_FREE}(?: to any person obtaining a copy of this software and associated documentation files)?", "hereby"),
    ("ncsa", f"{_FREE} to any person obtaining a copy of this software and associated documentation files the software to deal with the software", "hereby"),
    ("ofl", f"{_FREE} to any person obtaining a copy of the font software", "hereby"),
    ("bsl-1.0", f"{_FREE} to any person or organization obtaining a copy of the software and accompanying documentation", "hereby"),
    ("isc", f"{_ANY_USE} provided that", "hereby"),
    ("0bsd", f"{_ANY_USE}(?! provided that)", "hereby"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "hereby"),
    ("bsd", "redistribution and use in source and binary forms(?: with or without modification are permitted)?", "redistribution"),
    ("bsd-3-clause", r"neither the name of(?: \w+){1,20}? may be used to endorse or promote products derived from this software", "endorse"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "unless"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "liable"),
    ("zlib", "altered source versions must be plainly marked as such", "plainly"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", "dedicated"),
    ("wtfpl", "you just do what the fuck you want to", "fuck"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", "retain"),
)

_GRANT = r"(?:licensed|released|distributed|available|published|provided)(?: \w+){0,3}? under (?:the )?(?:terms of (?:the )?)?"
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NO_WORD_BEFORE, _NO_WORD_AFTER = r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])", r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int  # smaller goes first
    weight: float
    base: bool = False


def _spaced(pattern: str) -> str:
    return pattern.replace(" ", r"\s+").replace(r"[\s+", r"[\s")


def _version(version: str) -> str:
    major, _, minor = version.partition(".")
    tail = r"(?:\.0)?" if minor == "0" else re.escape(f".{minor}")
    return rf"(?:,?\s*\(?(?:version|ver\.?|v\.?)?)?\s*{major}{tail}(?![\d.]*\d)"


def build_rules() -> list[Rule]:
    """All rules in the order in which they are run."""
    rules = [
        Rule(label, _BREAK.join(map(re.escape, phrase.split())), (phrase.split()[0],), 0, 0.6, base=True)
        for phrase, label in BASE.items()
    ]
    for label, pattern, keyword, versions in FAMILIES:
        name, keywords = f"(?:{_spaced(pattern)})", KEYWORDS.get(label, (keyword,))
        for version in versions:
            full = f"{label}-{version}"
            rules.append(Rule(full, _spaced(_GRANT) + name + _version(version), keywords, 2, 0.95))
            rules.append(Rule(full, name + _version(version), keywords, 3, 0.85))
            rules.append(Rule(full, rf"spdx-license-identifier:\s*{re.escape(full)}", ("spdx",), 1, 1.0))
            rules.append(Rule(full, rf"licenses/{re.escape(label.removeprefix('cc-'))}[-/]{re.escape(version)}\b", ("licenses/",), 1, 0.9))
        rules.append(Rule(label, _spaced(_GRANT) + name, keywords, 4, 0.8))
        rules.append(Rule(label, name, keywords, 5, 0.5))
        rules.append(Rule(label, rf"spdx-license-identifier:\s*{re.escape(label)}(?![-\w.])", ("spdx",), 1, 1.0))
        if label in ("gpl", "lgpl", "agpl"):
            published = _BREAK + "as published by the free software foundation(?: either)?".replace(" ", _BREAK)
            for version in versions:
                rules.append(Rule(f"{label}-{version}", name + published + r"[,;]?" + _version(version), keywords, 2, 0.95))
    rules += [Rule(label, text.replace(" ", _BREAK), (keyword,), 4, 0.8) for label, text, keyword in SENTENCES]
    return sorted(rules, key=lambda r: r.priority)


@dataclass(frozen=True)
class Detection:
    rule: Rule
    start: int
    end: int


class Scanner:
    def __init__(self, rules: list[Rule] | None = None):
        self.rules = build_rules() if rules is None else rules
        self.compiled = [re.compile(f"{_NO_WORD_BEFORE}(?:{r.pattern}){_NO_WORD_AFTER}") for r in self.rules]
        owners: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            for keyword in rule.keywords:
                owners.setdefault(keyword, []).append(i)
        self.keywords = ahocorasick.Automaton()
        for keyword, numbers in owners.items():
            self.keywords.add_word(keyword, (keyword, numbers))
        self.keywords.make_automaton()
        # Nearly all texts name no license: all rules need one of these.
        self.gate = re.compile(
            r"licen[cs]|gpl|bsd|gfdl|cddl|eupl|lppl|wtfpl|odbl|cc|creative|spdx|mit\s+no"
            r"|hereby|redistribution|endorse|advertising|liable|plainly|unencumbered|dedicated|fuck|retain"
        )

    def scan(self, lowered: str) -> list[Detection]:
        """Detections in a lower-cased text that survive, by place."""
        if not self.gate.search(lowered):
            return []
        wanted: set[int] = set()
        # Patterns allow any run of white space (str.split's) where a keyword has one blank.
        for _, (_, numbers) in self.keywords.iter(" ".join(lowered.split())):
            wanted.update(numbers)
        found = [
            Detection(self.rules[i], m.start(), m.end()) for i in sorted(wanted) for m in self.compiled[i].finditer(lowered)
        ]
        return suppress(found)


def suppress(found: list[Detection]) -> list[Detection]:
    """Drop detections inside others of higher priority, or inside longer ones of the same; base rules stay.

    Of equal intervals of one priority the first in the order of rules stays.
    Detections are swept by place; those kept so far that end last decide, one
    for each priority.
    """
    order = sorted(range(len(found)), key=lambda i: (found[i].start, -found[i].end, found[i].rule.priority, i))
    reach: dict[int, int] = {}
    kept = []
    # An interval can only lie inside one that starts earlier, or at the same place and ends no earlier;
    # of equal intervals the sort has put the one of higher priority first.
    for i in order:
        d = found[i]
        inside = any(end >= d.end for priority, end in reach.items() if priority <= d.rule.priority)
        if d.rule.base:
            kept.append(d)
            continue
        if not inside:
            kept.append(d)
        reach[d.rule.priority] = max(reach.get(d.rule.priority, 0), d.end)
    return kept


SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, "
    "labels array<string>, score double, detections array<struct<label:string,start:bigint,end:bigint,base:boolean>>"
)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows of ``docs`` with the licenses that their texts name.

    Adds ``n_words``; ``n_base``, the places of base phrases, and
    ``first_word`` / ``last_word``, the smallest and largest word (from 0)
    where one starts (null without any); ``base_labels`` and ``labels``,
    sorted and distinct; ``score``, the largest weight of a detection that
    survived; and ``detections`` with character offsets of the original text.
    Columns of ``docs`` with one of these names are replaced.

    A null or empty text has no words and no labels and scores 0. Repeated
    rows are scanned each on its own.
    """

    def build():
        scanner = Scanner()
        spans = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        upper = {c: c + 32 for c in range(65, 91)}

        def one(text: str):
            found = scanner.scan(text.translate(upper))
            if not found:
                return len(terms(text)), 0, None, None, [], [], 0.0, []
            starts = [a for a, _ in term_spans(text)]
            words = [bisect_left(starts, d.start) for d in found if d.rule.base]
            base = sorted({d.rule.label for d in found if d.rule.base})
            rows = [{"label": d.rule.label, "start": d.start, "end": d.end, "base": d.rule.base} for d in found]
            return (
                len(starts), len(words), min(words, default=None), max(words, default=None), base,
                sorted({d.rule.label for d in found}), max(d.rule.weight for d in found), rows,
            )

        kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(spans)]

        def compute(texts: pa.Array) -> list[pa.Array]:
            columns = list(zip(*(one(t or "") for t in texts.to_pylist()))) or [()] * len(kinds)
            return [pa.array(c, kind) for c, kind in zip(columns, kinds)]

        return compute

    return add_columns(docs, text, SCHEMA, build)
