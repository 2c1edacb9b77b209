"""License scans: Aho-Corasick finds identifier tags and notice phrases; a shunting-yard parser reads expressions.

Words are runs of digits, ASCII letters (lower-cased) and all characters beyond ASCII. The automaton runs over the
words joined by single spaces, so a phrase is found however its words are set apart. Where it meets the words of
an identifier tag, the expression behind each tag of the raw text is read to the end of its line, turned to
postfix by the shunting-yard algorithm (WITH before AND before OR) and evaluated: its licences become labels, and
its worth is the least (AND), most (OR) or left side (WITH) of whether each identifier is known.

Defined results: null text counts as empty; without a label score is 0 and first_word and last_word are null;
repeated rows each give a row; a null doc_id stays null; a malformed expression gives its known identifiers only, a
well-formed one the label UNLISTED for all others.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrowed, per_block

#: Phrases and labels of the base.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "eclipse public license": "epl",
    "all rights reserved": "all-rights-reserved",
    "public domain": "public-domain",
    "creative commons": "creative-commons",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Identifiers and exceptions that expressions may name, with the short forms that SPDX has given up.
KNOWN = frozenset(
    "0bsd afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause "
    "bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 "
    "cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 curl ecl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.2 gfdl-1.3 gfdl-1.3-only gfdl-1.3-or-later gpl-1.0 gpl-1.0-only gpl-1.0-or-later "
    "gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later hpnd icu ijg isc lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only "
    "lgpl-3.0-or-later libpng lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 "
    "ruby sspl-1.0 unicode-3.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1 autoconf-exception-3.0 bison-exception-2.2 classpath-exception-2.0 font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 "
    "linux-syscall-note llvm-exception openssl-exception".split()
)
#: Label of identifiers in well-formed expressions that aren't known; they are worth nothing.
UNLISTED = "unlisted"
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKEN = re.compile(r"[()]|[a-z0-9.+-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """Postfix order by the shunting-yard algorithm; None if the expression is malformed."""
    out, stack, operand = [], [], True
    for token in _TOKEN.findall(expression.lower()):
        if token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token in _RANK:
            if operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def expression_in(text: str) -> str:
    """The expression that text begins with, up to where its grammar ends: prose behind an operand is left out, and so is an
    operator with a word behind it that is neither a known identifier nor looks like one (a digit or a hyphen in it). Such a word is an
    identifier only where it stands alone."""
    taken, ended, depth, operand = [], 0, 0, True
    for m in re.finditer(r"\s*([()]|[^\s()]+)", text):
        token = m[1]
        if token == "(" and operand:
            depth += 1
        elif token == ")" and not operand and depth:
            depth -= 1
        elif operand:
            word = token.rstrip(".,;")
            if not re.fullmatch(r"[a-z0-9][a-z0-9.+-]*", word) or ((taken or text[m.end() :].strip()) and word.rstrip("+") not in KNOWN and not re.search(r"[0-9-]", word)):
                break
            operand, token = False, word
        elif token in _RANK:
            operand = True
        else:
            break
        taken.append(token)
        if not operand:
            ended = len(taken)
        if token != m[1]:
            break  # the sentence ends here
    return " ".join(taken[:ended])


def evaluated(expression: str) -> tuple[set[str], float]:
    """Known identifiers that the expression names, UNLISTED if it is well-formed and names others, and its worth from 0 to 1."""
    named = [t for t in _TOKEN.findall(expression.lower()) if t not in _RANK and t not in "()"]
    labels = {t for t in named if t.rstrip("+") in KNOWN}
    order = postfix(expression)
    if order is None:
        return labels, 0.5 * bool(labels)
    if any(t.rstrip("+") not in KNOWN for t in named):
        labels.add(UNLISTED)
    stack: list[float] = []
    for token in order:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(min(left, right) if token == "and" else max(left, right) if token == "or" else left if right else left / 2)
        else:
            stack.append(float(token.rstrip("+") in KNOWN))
    return labels, stack[0]


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", more_phrases: dict[str, str] = MORE_PHRASES) -> DataFrame:
    """One row per row of df: number of words, places of the base phrases, labels of the base and of the method, score.

    score is 1 - 0.5 ** (number of distinct labels from phrases) * (1 - worth of the best expression)."""
    phrases = {**{p: (label, True) for p, label in BASE_PHRASES.items()}, **{p: (label, False) for p, label in more_phrases.items() if p not in BASE_PHRASES}}
    tags = {re.sub(r"[^0-9a-z]+", " ", t).strip(): t for t in TAGS}
    kept: list = []

    def automaton():
        if not kept:
            machine = ahocorasick.Automaton()
            for p, (label, base) in phrases.items():
                machine.add_word(f" {p} ", (p, label, base))
            for words in tags:
                machine.add_word(f" {words} ", (words, None, False))
            machine.make_automaton()
            kept.append(machine)
        return kept[0]

    def block(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        machine, raw = automaton(), data.tobytes()
        spaced, out = raw.translate(_WORD_BYTES), []
        for k in range(rows.num_rows):
            words = spaced[offsets[k] : offsets[k + 1]].split()
            joined = f" {b' '.join(words).decode('latin-1')} "  # a character a byte, as the phrases are ASCII
            hits = list(machine.iter(joined))
            if not hits:
                out.append((len(words), 0, None, None, "", "", 0.0))
                continue
            spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
            base, more, places, tagged = set(), set(), [], False
            for end, (phrase, label, is_base) in hits:
                if label is None:
                    tagged = True
                elif is_base:
                    base.add(label)
                    places.append(int(np.searchsorted(spaces, end - len(phrase) - 1)))
                else:
                    more.add(label)
            miss, worth = 0.5 ** len(base | more), 0.0
            if tagged:
                lower = raw[offsets[k] : offsets[k + 1]].translate(_LOWER).decode("utf-8", "replace")
                for tag in tags.values():
                    for part in lower.split(tag)[1:]:
                        own, value = evaluated(expression_in(part.split("\n", 1)[0]))
                        more |= own
                        worth = max(worth, value)
            out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1 - miss * (1 - worth)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return per_block(narrowed(df, id_col, text_col), block, SCHEMA)
