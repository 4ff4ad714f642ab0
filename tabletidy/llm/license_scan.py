"""License scans (operator 9): Aho-Corasick finds identifier tags and notice phrases, and a
shunting-yard parser evaluates the and/or/with expressions behind the tags.

Every text is read once by Arrow batches; the automaton is built once per worker from
fixed phrase tables. No shuffle, no state across rows.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tabletidy.llm.common import map_rows

#: The base notice phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases of this scan and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "bsd license": "bsd",
    "2 clause bsd": "bsd-2-clause",
    "3 clause bsd": "bsd-3-clause",
    "boost software license": "bsl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "creative commons attribution": "cc-by",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Words that contain A-Z in lower case, digits or any byte above ASCII; all else separates.
TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
TAG_LINE = re.compile(rb"spdx-license-identifier\s*:?[ \t]*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
BINDS = {"or": 1, "and": 2, "with": 3}
#: Identifiers of the public SPDX licence list that stand alone.
SINGLE = """
0BSD AAL Adobe-2006 AMDPLPA Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-1.0-cl8
Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-2-Clause-Views BSD-3-Clause
BSD-3-Clause-Attribution BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-3-Clause-Modification BSD-3-Clause-No-Nuclear-License
BSD-3-Clause-Open-MPI BSD-4-Clause BSD-4-Clause-UC BSD-Protection BSD-Source-Code BSL-1.0 BUSL-1.1 bzip2-1.0.6 CAL-1.0
CATOSL-1.1 CC0-1.0 CC-PDDC CECILL-1.0 CECILL-1.1 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C ClArtistic CNRI-Python
CPAL-1.0 CPL-1.0 CPOL-1.02 CUA-OPL-1.0 curl ECL-1.0 ECL-2.0 EFL-1.0 EFL-2.0 Elastic-2.0 Entessa EUDatagrid
Fair Frameworx-1.0 FSFAP FSFUL FSFULLR FTL HPND ICU IJG ImageMagick Info-ZIP Intel IPA IPL-1.0 ISC JasPer-2.0
JSON LAL-1.2 LAL-1.3 libpng-2.0 Libpng libtiff LiLiQ-P-1.1 LiLiQ-R-1.1 LiLiQ-Rplus-1.1 Linux-OpenIB LPL-1.0 LPL-1.02
MIT MIT-0 MIT-advertising MIT-CMU MIT-enna MIT-feh MIT-Modern-Variant MITNFA MirOS Motosoto MS-PL MS-RL
MulanPSL-1.0 MulanPSL-2.0 Multics NAIST-2003 NASA-1.3 Naumen NCSA NetCDF NGPL Nokia NPOSL-3.0 NTP NTP-0 Nunit
OCLC-2.0 ODbL-1.0 ODC-By-1.0 OGTSL OML OpenSSL PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0
Qhull RPL-1.1 RPL-1.5 RPSL-1.0 RSCPL Ruby SAX-PD Sendmail SGI-B-2.0 SimPL-2.0 SISSL Sleepycat SMLNJ SPL-1.0 SSPL-1.0
TCL UCL-1.0 Unicode-DFS-2015 Unicode-DFS-2016 Unlicense UPL-1.0 Vim VSL-1.0 W3C Watcom-1.0 WTFPL X11 Xnet Zlib
zlib-acknowledgement
"""
#: Licences of that list that have versions; those of FREE also as "-only" and "-or-later".
VERSIONS = {
    "AFL": "1.1 1.2 2.0 2.1 3.0", "APSL": "1.0 1.1 1.2 2.0", "CDDL": "1.0 1.1", "EPL": "1.0 2.0", "EUPL": "1.0 1.1 1.2",
    "LPPL": "1.0 1.1 1.2 1.3a 1.3c", "MPL": "1.0 1.1 2.0", "NPL": "1.0 1.1", "OFL": "1.0 1.1", "OSL": "1.0 1.1 2.0 2.1 3.0",
    "ZPL": "1.1 2.0 2.1", "CC-BY": "1.0 2.0 2.5 3.0 4.0", "CC-BY-NC": "1.0 2.0 2.5 3.0 4.0", "CC-BY-NC-ND": "1.0 2.0 2.5 3.0 4.0",
    "CC-BY-NC-SA": "1.0 2.0 2.5 3.0 4.0", "CC-BY-ND": "1.0 2.0 2.5 3.0 4.0", "CC-BY-SA": "1.0 2.0 2.5 3.0 4.0",
}
FREE = {"AGPL": "1.0 3.0", "GFDL": "1.1 1.2 1.3", "GPL": "1.0 2.0 3.0", "LGPL": "2.0 2.1 3.0"}
#: Exceptions of the public SPDX list.
EXCEPTIONS = """
389-exception Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0
CLISP-exception-2.0 DigiRule-FOSS-exception eCos-exception-2.0 Fawkes-Runtime-exception FLTK-exception Font-exception-2.0
freertos-exception-2.0 GCC-exception-2.0 GCC-exception-3.1 gnu-javamail-exception GPL-3.0-linking-exception GPL-CC-1.0
i2p-gpl-java-exception LGPL-3.0-linking-exception Libtool-exception Linux-syscall-note LLVM-exception LZMA-exception
mif-exception Nokia-Qt-exception-1.1 OCaml-LGPL-linking-exception OCCT-exception-1.0 OpenJDK-assembly-exception-1.0
openvpn-openssl-exception PS-or-PDF-font-exception-20170817 Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 Qwt-exception-1.0
SHL-2.0 SHL-2.1 Swift-exception u-boot-exception-2.0 Universal-FOSS-exception-1.0 WxWindows-exception-3.1
"""
FREE_IDS = {f"{name}-{v}{end}" for name, vs in FREE.items() for v in vs.split() for end in ("", "-only", "-or-later")}
KNOWN = {x.lower() for x in {*SINGLE.split(), *(f"{name}-{v}" for name, vs in VERSIONS.items() for v in vs.split()), *FREE_IDS}}
KNOWN_EXCEPTIONS = {x.lower() for x in EXCEPTIONS.split()}
OWN = re.compile(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+\Z")


def standing(identifier: str) -> float:
    """1 for a listed identifier (a ``+`` behind it means later versions too), 0.75 for a
    well-formed reference to a licence of the file's own, 0.5 for any other."""
    low = identifier.lower()
    later = low.endswith("+") and not low.endswith(("-only+", "-or-later+"))
    if (low[:-1] if later else low) in KNOWN:
        return 1.0
    return 0.75 if OWN.match(low) else 0.5


@functools.cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG: ""}.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE, phrase == TAG))
    found.make_automaton()
    return found


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels and score (0 to 1) of the longest well-formed start of a licence expression.

    Shunting yard: operands go out, operators wait on a stack until one that binds less
    arrives (``with`` before ``and`` before ``or``), brackets bound it. Identifiers score as in
    ``standing``; ``and`` takes the least of its sides, ``or`` the best. ``with`` stands between a
    single licence and one exception, which the label names behind a ``+``; an exception that is
    not listed scores 0.5 at most.
    """
    tokens, depth, operand = [], 0, True
    good = 0  # tokens up to here form a whole expression
    for token in TOKEN.findall(expression):
        low = token.lower()
        if operand and low == "(" and tokens[-1:] != ["with"]:
            depth += 1
        elif operand and low not in BINDS and low not in ("(", ")"):
            operand = False
        elif not operand and low == ")" and depth:
            depth -= 1
        elif not operand and low in BINDS and (low != "with" or (tokens[-1] != ")" and tokens[-2:-1] != ["with"])):
            operand = True
        else:
            break
        tokens.append(low)
        if not operand and not depth:
            good = len(tokens)
    out: list[tuple[frozenset[str], float]] = []
    waiting: list[str] = []

    def apply(op: str) -> None:
        (right, r), (left, x) = out.pop(), out.pop()
        if op == "with":
            out.append((frozenset(f"{a}+{b}" for a in left for b in right), x if right <= KNOWN_EXCEPTIONS else min(x, 0.5)))
        else:
            out.append((left | right, min(x, r) if op == "and" else max(x, r)))

    for token in tokens[:good]:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                apply(waiting.pop())
            waiting.pop()
        elif token in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[token]:
                apply(waiting.pop())
            waiting.append(token)
        else:
            out.append((frozenset([token]), standing(token)))
    while waiting:
        apply(waiting.pop())
    return (set(out[0][0]), out[0][1]) if out else (set(), 0.0)


def scan(text: bytes) -> dict:
    """Words, places of phrases (word index, label, is base), tag expressions and the score."""
    words = text.translate(TABLE).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    places, tagged = [], False
    at = index = 0
    hits = sorted((end + 1 - n, label, base, tag) for end, (n, label, base, tag) in automaton().iter(line))
    for start, label, base, tag in hits:
        index, at = index + line.count(" ", at, start), start
        if tag:
            tagged = True
        else:
            places.append((index, label, base))
    expressions = [evaluate(m.decode("utf-8", "replace")) for m in TAG_LINE.findall(text)] if tagged else []
    score = max([0.0, *(0.8 if base else 0.7 for _, _, base in places), *(s for _, s in expressions)])
    return {"n_words": len(words), "places": places, "expressions": expressions, "score": score}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<word:long,label:string>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the contract's columns and ``places``, every phrase with its word.

    Null and empty texts have no words, no places, empty labels and score 0. Matches overlap
    freely ("cc by" stands inside "cc by sa" and both count). ``labels`` holds the base labels,
    those of the further notices, and the identifiers of well-formed tag expressions; the
    score is the best piece of evidence (expression 0.5 to 1, base phrase 0.8, other 0.7). Rows that
    repeat an id give a row each; texts of any length are read whole.
    """

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(9)]
        for ident, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            found = scan((text or "").encode("utf-8"))
            base = [w for w, _, is_base in found["places"] if is_base]
            base_labels = {x for _, x, is_base in found["places"] if is_base}
            labels = {x for _, x, _ in found["places"]}.union(*(x for x, _ in found["expressions"]))
            row = (ident, found["n_words"], len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), found["score"], [{"word": w, "label": x} for w, x, _ in found["places"]])
            for column, value in zip(out, row, strict=True):
                column.append(value)
        long, text_t = pa.int64(), pa.string()
        types = [long, long, long, long, long, text_t, text_t, pa.float64(), pa.list_(pa.struct([("word", long), ("label", text_t)]))]
        return pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])

    picked = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return map_rows(picked, "text", SCHEMA, rows).withColumnRenamed("doc_id", id_col)
