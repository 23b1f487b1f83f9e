"""License scans: Aho-Corasick passes over the text, and a parser of licence expressions.

The text is folded byte by byte (ASCII lower case, signs to blanks, other bytes kept). One automaton finds
notice phrases at word edges, in the folded words joined by single blanks; another finds identifier tags in
the folded text itself, where places are those of the raw text. The expression after a tag, as far as the
line or the next tag, goes through a shunting-yard parser for and/or/with and parentheses, which reads no
further than the expression continues, and is evaluated: to the ids that it names (an exception makes ``id
with exception``) and to those that every way to satisfy it holds, so that and/or tell. ``with`` joins one id
and one exception, nothing larger. Ids and exceptions must be known ones or the document's own
(``LicenseRef-``, ``AdditionRef-``); others stand in ``unknown`` and neither label nor score.

Defined results: null text is empty text; very long texts and expressions are read whole; an empty table
gives an empty result; repeated rows are handled row by row; the score of several finds is the largest;
extra columns, whatever their names, take no part. A tag whose expression does not parse yields what
precedes the error.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, table

#: The contract's phrases and labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases of the method: words, label, whether the phrase alone is a notice (1) or a hint (0.5).
NOTICES = {
    "licensed under the apache license version 2 0": ("apache-2.0", 1.0),
    "permission is hereby granted free of charge": ("mit", 1.0),
    "released under the mit license": ("mit", 1.0),
    "licensed under the mit license": ("mit", 1.0),
    "redistribution and use in source and binary forms": ("bsd", 1.0),
    "gnu general public license": ("gpl", 0.8),
    "gnu general public license version 2": ("gpl-2.0", 1.0),
    "gnu general public license version 3": ("gpl-3.0", 1.0),
    "gnu lesser general public license": ("lgpl", 1.0),
    "gnu affero general public license": ("agpl", 1.0),
    "mozilla public license": ("mpl", 1.0),
    "eclipse public license": ("epl", 1.0),
    "licensed under cc by 4 0": ("cc-by-4.0", 1.0),
    "licensed under cc by sa 4 0": ("cc-by-sa-4.0", 1.0),
    "licensed under cc by nc 4 0": ("cc-by-nc-4.0", 1.0),
    "creative commons attribution": ("cc-by", 0.8),
    "licensed under cc by nd 4 0": ("cc-by-nd-4.0", 1.0),
    "licensed under cc by nc sa 4 0": ("cc-by-nc-sa-4.0", 1.0),
    "licensed under cc by nc nd 4 0": ("cc-by-nc-nd-4.0", 1.0),
    "cc0 1 0 universal": ("cc0-1.0", 1.0),
    "dedicated to the public domain": ("public-domain", 0.8),
    "this is free and unencumbered software released into the public domain": ("unlicense", 1.0),
    "apache license version 2 0": ("apache-2.0", 1.0),
    "apache 2 0 license": ("apache-2.0", 1.0),
    "the software is provided as is without warranty of any kind": ("mit", 0.8),
    "permission to use copy modify and or distribute this software": ("isc", 1.0),
    "2 clause bsd license": ("bsd-2-clause", 1.0),
    "3 clause bsd license": ("bsd-3-clause", 1.0),
    "bsd 2 clause license": ("bsd-2-clause", 1.0),
    "bsd 3 clause license": ("bsd-3-clause", 1.0),
    "simplified bsd license": ("bsd-2-clause", 1.0),
    "new bsd license": ("bsd-3-clause", 1.0),
    "modified bsd license": ("bsd-3-clause", 1.0),
    "gplv2 license": ("gpl-2.0", 0.8),
    "gplv3 license": ("gpl-3.0", 0.8),
    "gpl v2 license": ("gpl-2.0", 0.8),
    "gpl v3 license": ("gpl-3.0", 0.8),
    "licensed under the gplv2": ("gpl-2.0", 1.0),
    "licensed under the gplv3": ("gpl-3.0", 1.0),
    "released under the gplv2": ("gpl-2.0", 1.0),
    "released under the gplv3": ("gpl-3.0", 1.0),
    "gnu lesser general public license version 2 1": ("lgpl-2.1", 1.0),
    "gnu lesser general public license version 3": ("lgpl-3.0", 1.0),
    "gnu affero general public license version 3": ("agpl-3.0", 1.0),
    "gnu free documentation license": ("gfdl", 1.0),
    "mozilla public license version 2 0": ("mpl-2.0", 1.0),
    "mozilla public license v 2 0": ("mpl-2.0", 1.0),
    "eclipse public license v 2 0": ("epl-2.0", 1.0),
    "european union public licence": ("eupl", 1.0),
    "boost software license": ("bsl-1.0", 1.0),
    "artistic license": ("artistic", 0.8),
    "zlib license": ("zlib", 1.0),
    "open database license": ("odbl", 1.0),
    "sil open font license": ("ofl", 1.0),
    "microsoft public license": ("ms-pl", 1.0),
    "academic free license": ("afl", 1.0),
    "open software license": ("osl", 1.0),
    "common development and distribution license": ("cddl", 1.0),
    "do what the fuck you want to public license": ("wtfpl", 1.0),
    "bsd license": ("bsd", 0.8),
    "isc license": ("isc", 0.8),
    "all rights reserved": ("all-rights-reserved", 0.3),
}
# Licence identifiers and exceptions of public lists, lower case; families by their versions.
_SINGLE = """0bsd adobe-2006 apsl-2.0 artistic-1.0 artistic-1.0-perl artistic-2.0 beerware blessing bsd-1-clause bsd-2-clause
bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-3-clause-lbnl bsd-4-clause bsd-4-clause-uc bsd-source-code bsl-1.0
busl-1.1 bzip2-1.0.6 cc0-1.0 cc-pddc cecill-2.0 cecill-2.1 cecill-b cecill-c clartistic cpal-1.0 cpl-1.0 curl ecl-2.0 elastic-2.0
fsfap ftl hpnd icu ijg imagemagick intel ipl-1.0 isc json libpng libpng-2.0 libtiff lppl-1.3c mit mit-0 mit-cmu mit-modern-variant
mulanpsl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl ncsa nist-pd odbl-1.0 odc-by-1.0 openssl pddl-1.0 php-3.0 php-3.01
postgresql psf-2.0 python-2.0 qpl-1.0 ruby sendmail sgi-b-2.0 sissl sleepycat spl-1.0 sspl-1.0 unicode-3.0 unicode-dfs-2016
unlicense upl-1.0 vim w3c wtfpl x11 xfree86-1.1 zlib zlib-acknowledgement zpl-2.1"""
_FAMILIES = {
    "afl": "1.1 1.2 2.0 2.1 3.0", "apache": "1.0 1.1 2.0", "cddl": "1.0 1.1", "epl": "1.0 2.0", "eupl": "1.0 1.1 1.2", "mpl": "1.0 1.1 2.0", "ofl": "1.0 1.1", "osl": "1.0 1.1 2.0 2.1 3.0",
    **dict.fromkeys(("cc-by", "cc-by-nc", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nd", "cc-by-sa"), "1.0 2.0 2.5 3.0 4.0"),
}
_COPYLEFT = {"agpl": "1.0 3.0", "gfdl": "1.1 1.2 1.3", "gpl": "1.0 2.0 3.0", "lgpl": "2.0 2.1 3.0"}
#: Known ids; a + at the end means this version or later.
IDS = frozenset(_SINGLE.split()) | {f"{f}-{v}" for f, x in _FAMILIES.items() for v in x.split()} | {f"{f}-{v}{e}" for f, x in _COPYLEFT.items() for v in x.split() for e in ("", "-only", "-or-later")}
EXCEPTIONS = frozenset("""autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 ecos-exception-2.0
font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gpl-cc-1.0 lgpl-3.0-linking-exception libtool-exception linux-syscall-note
llvm-exception openssl-exception qt-gpl-exception-1.0 qt-lgpl-exception-1.1 u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1""".split())  # fmt: skip
_OWN = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
#: Identifier tags, lower case.
TAGS = (b"spdx-license-identifier:", b"license-expression:")
_LINE_END = re.compile(rb"[\r\n]")
_PART = re.compile(rb"\(|\)|DocumentRef-[A-Za-z0-9.-]+:LicenseRef-[A-Za-z0-9.-]+|[A-Za-z0-9][A-Za-z0-9.+-]*")
#: Every phrase and tag holds one of these.
_HINTS = (b"licen", b"permission", b"redistribution", b"rights", b"creative", b"public domain", b"cc0", b"gplv", b"as is")
_RANK = {"or": 1, "and": 2, "with": 3}
#: Bytes outside the contract's words become blanks; A-Z become lower case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def parse(expression: bytes, start: int = 0, end: int | None = None) -> list[str]:
    """Shunting-yard: the expression in postfix order, lower case.

    Reading stops at the first part that cannot continue the expression; an operator left without
    a right side is dropped. ``start`` and ``end`` bound what is read.
    """
    out: list[str] = []
    stack: list[str] = []
    opened, wants_id, single = 0, True, False  # single: the last part is an id that may have an exception
    for m in _PART.finditer(expression, start, len(expression) if end is None else end):
        part = m[0].decode().lower()
        if wants_id:
            after = stack[-1] if stack else ""
            if part == "(" and after != "with":
                stack.append(part)
                opened += 1
            elif part in _RANK or part in "()":
                break
            else:
                out.append(part)
                wants_id, single = False, after != "with"
        elif part == ")":
            if not opened:
                break
            while (top := stack.pop()) != "(":
                out.append(top)
            opened, single = opened - 1, False
        elif part in _RANK and (single or part != "with"):
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[part]:
                out.append(stack.pop())
            stack.append(part)
            wants_id = True
        else:
            break
    if wants_id:  # an operator, and what was opened after it, lack a right side
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    return out + [s for s in reversed(stack) if s != "("]


def evaluate(postfix: list[str]) -> tuple[set[str], set[str]]:
    """All ids of an expression, and those in every set of ids that satisfies it.

    Both follow from the two sides of an operator; the smaller side joins the larger, so long
    expressions cost about linear time and the ways to satisfy one are never listed. ``with`` has
    one id on either side.
    """
    stack: list[tuple[set[str], set[str]]] = []
    for part in postfix:
        if part not in _RANK:
            stack.append(({part}, {part}))
            continue
        (more, must), (ids, needs) = stack.pop(), stack.pop()
        if part == "with":
            name = f"{min(ids)} with {min(more)}"
            stack.append(({name}, {name}))
            continue
        ids, more = (ids, more) if len(ids) >= len(more) else (more, ids)
        ids |= more
        needs, must = (needs, must) if len(needs) >= len(must) else (must, needs)
        if part == "and":
            needs |= must
        else:
            needs = {i for i in must if i in needs}
        stack.append((ids, needs))
    return stack[-1] if stack else (set(), set())


def known(name: str) -> tuple[str, set[str]]:
    """What of ``id`` or ``id with exception`` is known (empty: nothing), and the parts that are not."""
    own, _, exception = name.partition(" with ")
    if own not in IDS and own.removesuffix("+") not in IDS and not _OWN.fullmatch(own):
        return "", {own}
    if not exception or exception in EXCEPTIONS or exception.startswith("additionref-"):
        return name, set()
    return own, {exception}


def automata():
    """Of notice phrases, and of tags."""
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for p, label in BASE.items():
        phrases.add_word(f" {p} ", (p, label, 1.0, True))
    for p, (label, weight) in NOTICES.items():
        phrases.add_word(f" {p} ", (p, label, weight, False))
    for t in TAGS:
        tags.add_word(t.translate(_FOLD).decode("latin-1"), t)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def expressions(text: bytes, folded: bytes, tags):
    """The expressions after the tags of a text, evaluated."""
    found = [(end + 1 - len(t), end + 1) for end, t in tags.iter(folded.decode("latin-1")) if text[end + 1 - len(t) : end + 1].lower() == t]
    eol = -1
    for (_, start), (stop, _) in zip(found, [*found[1:], (len(text), 0)], strict=False):
        if eol < start:
            m = _LINE_END.search(text, start)
            eol = m.start() if m else len(text)
        yield evaluate(parse(text, start, min(eol, stop)))


def scan(text: bytes | None, phrases, tags) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, required, unknown of one text."""
    text = text or b""
    folded = text.translate(_FOLD)
    words = folded.split()
    base, labels, required, unknown, starts, score = set(), set(), set(), set(), [], 0.0
    if any(h in folded for h in _HINTS):
        flat = (b" " + b" ".join(words) + b" ").decode("latin-1")
        done = at = 0
        for end, (p, label, weight, is_base) in phrases.iter(flat):
            labels.add(label)
            score = max(score, weight)
            if is_base:
                base.add(label)
                start = end - len(p) - 1
                done += flat.count(" ", at, start)  # ends rise, and base phrases never overlap
                at = start
                starts.append(done)
        for ids, needs in expressions(text, folded, tags):
            for i in ids:
                name, rest = known(i)
                unknown |= rest
                if name:
                    labels.add(name)
                    score = 1.0
                    if i in needs:
                        required.add(name)
    join = lambda x: ",".join(sorted(x, key=lambda s: s.encode()))
    return len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, join(base), join(labels), score, join(required), join(unknown)


def scan_table(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, and what ``scan`` finds; ``required`` holds the ids that each expression's every way needs, ``unknown`` what stands for an id and is none."""
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "required", "unknown"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.string()]

    def scanned(batches):
        phrases, tags = automata()
        for b in batches:
            out = [scan(t.as_py(), phrases, tags) for t in b.column("text")]
            cols = [b.column("doc_id"), *(zip(*out) if out else [[]] * (len(names) - 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(cols, kinds, strict=True)], names)

    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, required string, unknown string")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_table(table(spark, sf_dir, "documents"))
