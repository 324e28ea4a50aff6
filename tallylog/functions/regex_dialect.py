"""Regular expressions of the linear-time dialect, for Java's engine.

``to_java`` keeps what a pattern matches: ends of text, white space, the dot, word borders,
case folding and brackets in classes mean different things to the two engines.  What only
Java would accept (lookaround, references, atomic and possessive parts) is refused.
"""

from __future__ import annotations

import re

_WORD = "0-9A-Za-z_"
_BORDER = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
_NO_BORDER = f"(?:(?<![{_WORD}])(?![{_WORD}])|(?<=[{_WORD}])(?=[{_WORD}]))"
_SPACE = r"\t\n\f\r "


class PatternError(ValueError):
    """A pattern outside the dialect; its text is not repeated."""


def to_java(pattern: str) -> str:
    out, k, n = [], 0, len(pattern)
    single = multi = False
    while k < n:
        c = pattern[k]
        if c == "\\":
            if k + 1 >= n:
                raise PatternError("a pattern ends in a backslash")
            e = pattern[k + 1]
            if e.isdigit() and e != "0" or e in "kGZ":
                raise PatternError("references aren't part of the dialect")
            if e in "pP" and pattern[k + 2 : k + 3] == "{":
                end = pattern.find("}", k)
                out.append(pattern[k : end + 1])
                k = end + 1
                continue
            out.append({"s": f"[{_SPACE}]", "S": f"[^{_SPACE}]", "b": _BORDER, "B": _NO_BORDER, "d": "[0-9]", "D": "[^0-9]", "w": f"[{_WORD}]", "W": f"[^{_WORD}]"}.get(e, c + e))
            k += 2
        elif c == "[":
            part, k = _class(pattern, k)
            out.append(part)
        elif c == "(" and pattern[k + 1 : k + 2] == "?":
            head = re.match(r"\(\?(?:P?<([A-Za-z_][A-Za-z0-9_]*)>|([imsU-]*)([:)]))", pattern[k:])
            if not head:
                raise PatternError("lookaround and atomic groups aren't part of the dialect")
            if head[1]:
                out.append("(")
            else:
                on = head[2].partition("-")[0]
                single, multi = single or "s" in on, multi or "m" in on
                out.append(f"(?{head[2].replace('i', 'iu', 1) if 'i' in on else head[2]}{head[3]}")
            k += head.end()
        else:
            if c in "*+?}" and pattern[k + 1 : k + 2] == "+":
                raise PatternError("possessive repeats aren't part of the dialect")
            out.append({".": "." if single else "[^\\n]", "$": "$" if multi else "\\z", "^": "^" if multi else "\\A"}.get(c, c))
            k += 1
    found = "".join(out)
    return "(?d)" + found if multi else found


def _class(pattern: str, k: int) -> tuple[str, int]:
    """The bracket expression at ``k`` and where it ends."""
    out, j = ["["], k + 1
    if pattern[j : j + 1] == "^":
        out.append("^")
        j += 1
    first = True
    while j < len(pattern):
        c = pattern[j]
        if c == "]" and not first:
            return "".join(out) + "]", j + 1
        if c == "\\" and j + 1 < len(pattern):
            e = pattern[j + 1]
            out.append(_SPACE if e == "s" else "0-9" if e == "d" else _WORD if e == "w" else c + e)
            j += 2
        elif c == "[" and (named := re.match(r"\[:(\^?)(alpha|digit|alnum|upper|lower|space|punct|xdigit):\]", pattern[j:])):
            out.append(("\\P" if named[1] else "\\p") + "{" + {"xdigit": "XDigit"}.get(named[2], named[2].capitalize() if named[2] != "alnum" else "Alnum") + "}")
            j += named.end()
        else:
            out.append("\\" + c if c in "[&]" else c)
            j += 1
        first = False
    raise PatternError("a class doesn't end")
