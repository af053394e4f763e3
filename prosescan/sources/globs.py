"""Path excludes: * stops at a slash, ** crosses them, a trailing slash stands for all below."""

from __future__ import annotations

import re
from pathlib import Path

from prosescan.errors import ExcludeError


def glob_regex(glob: str) -> str:
    """The regular expression of a glob: ?, *, **, [..] and {a,b}."""
    if glob.endswith("/"):
        glob += "**"
    out, k, depth = "", 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if glob.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "[":
            end = glob.find("]", k + 2)
            if end < 0:
                raise ExcludeError(f"`{glob}`: a class isn't closed")
            inside = glob[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
            continue
        if c == "{":
            depth += 1
        if c == "}" and depth == 0 or c == "\\" and k + 1 == len(glob):
            raise ExcludeError(f"`{glob}` isn't a glob")
        if c == "\\":
            k += 1
            out += re.escape(glob[k])
        else:
            out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else re.escape(c))
        depth -= c == "}"
        k += 1
    if depth:
        raise ExcludeError(f"`{glob}`: braces aren't closed")
    return out + r"\Z"


class Excludes:
    """Globs relative to a root. A path outside the root is never excluded."""

    def __init__(self, root: str | Path | None = None, globs: tuple[str, ...] = ()):
        self.root = Path(root).resolve() if root else None
        self.patterns = [re.compile(glob_regex(g), re.DOTALL) for g in globs]

    def __call__(self, path: str | Path) -> bool:
        if not self.patterns or self.root is None:
            return False
        try:
            inside = Path(path).resolve().relative_to(self.root).as_posix()
        except ValueError:
            return False
        return any(p.match(inside) for p in self.patterns)
