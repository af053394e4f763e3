"""Column expressions over text: ASCII folding, white space, words, literal matchers, byte slices."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Unicode white space, as the inside of a character class that Java and RE2 read alike.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = "[A-Za-z0-9']+"
#: Blank lines, with the line feeds around them: what separates paragraphs.
BLANK_LINES = rf"\n[{SPACE}]*\n"
LIST_ITEM = r"^(?:[-*+] |[0-9]+\. )"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(WORD), F.lit(0))


def lead(x: Column) -> Column:
    """Leading white space."""
    return F.regexp_extract(x, rf"^[{SPACE}]*", 0)


def trim(x: Column) -> Column:
    return F.regexp_replace(x, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def trim_left(x: Column) -> Column:
    return F.regexp_replace(x, rf"^[{SPACE}]+", "")


def slice_bytes(x: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets."""
    return F.substring(x.cast("binary"), (start + 1).cast("int"), (end - start).cast("int")).cast("string")


def starts_with_any(x: Column, openings: Iterable[str]) -> Column:
    low = ascii_lower(x)
    out = F.lit(False)
    for opening in openings:
        out = out | F.startswith(low, F.lit(opening))
    return out


def reachable(literals: list[str]) -> list[str]:
    """Literals that leftmost-first matching can find: those that no earlier one is a prefix of. Of two prefixes left, the longer is the earlier, so the longest may be preferred."""
    out: list[str] = []
    for x in literals:
        if not any(x.startswith(y) for y in out):
            out.append(x)
    return out


def trie_regex(literals: list[str], ahead: bool = True) -> str:
    """One regular expression that finds the longest of the literals, with common beginnings factored out.
    ahead: with a look at the first character before the rest (which RE2 doesn't know)."""
    trie: dict = {}
    for literal in literals:
        node = trie
        for c in literal:
            node = node.setdefault(c, {})
        node[""] = {}

    def build(node: dict) -> str:
        arms = []
        for c in sorted(k for k in node if k):
            run, below = quoted(c), node[c]
            while len(below) == 1 and "" not in below:
                (d, below), = below.items()
                run += quoted(d)
            arms.append(run + build(below))
        if not arms:
            return ""
        body = arms[0] if len(arms) == 1 and "" not in node else "(?:" + "|".join(arms) + ")"
        return body + "?" if "" in node else body

    first = sorted({x[0] for x in literals})
    return (f"(?=[{''.join(map(in_class, first))}])" if ahead and literals else "") + build(trie)


def quoted(c: str) -> str:
    return re.escape(c) if c.isascii() and not c.isalnum() and c not in " '\"#&,-/:;<=>@_`~%!" else c


def in_class(c: str) -> str:
    return "\\" + c if c in "\\]^-[&" else c
