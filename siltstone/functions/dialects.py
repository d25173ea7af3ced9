"""Regular expressions and time layouts, from the dialects of configs to Java's."""

from __future__ import annotations

import re

# POSIX classes, and the parts of a time layout with Java's pattern letters.
POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "xdigit": "XDigit", "cntrl": "Cntrl", "print": "Print", "graph": "Graph", "blank": "Blank"}
LAYOUT = (
    ("January", "MMMM"), ("Jan", "MMM"), ("2006", "yyyy"), ("-07:00", "OFFSET"), ("-0700", "OFFSET"), ("Z07:00", "OFFSET"), ("Z0700", "OFFSET"), ("MST", "OFFSET"),
    (".000000", ".SSSSSS"), (".000", ".SSS"), ("01", "MM"), ("02", "dd"), ("_2", "d"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("15", "HH"), ("PM", "a"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"),
)
OFFSET = r"\s*(?:[+-]\d{2}:?\d{2}|Z|[A-Z]{3,4})$"


def java_regex(pattern: str) -> str:
    """The pattern for Java: named groups lose their names (use group_index), POSIX classes change."""
    if pattern == "":
        raise ValueError("an empty regular expression")
    for name, java in POSIX.items():
        pattern = pattern.replace(f"[[:{name}:]]", rf"\p{{{java}}}").replace(f"[:{name}:]", rf"\p{{{java}}}")
    return re.sub(r"\(\?P?<\w+>", "(", pattern)


def group_names(pattern: str) -> dict[str, int]:
    """The number of each named group, counted as Java counts groups."""
    found, number, k, in_class = {}, 0, 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            k += pattern[k + 1 : k + 2] == "]"
        elif c == "(":
            named = re.match(r"\(\?P?<(\w+)>", pattern[k:])
            if named or pattern[k + 1 : k + 2] != "?":
                number += 1
            if named:
                found[named[1]] = number
        k += 1
    return found


def java_layout(layout: str) -> tuple[str, set[str], bool]:
    """(pattern, the date fields it has, whether an offset ends it) for a layout such as 2006-01-02 15:04:05."""
    out, literal, names, offset, k = [], [], set(), False, 0
    while k < len(layout):
        part = next((x for x in LAYOUT if layout.startswith(x[0], k)), None)
        if part is None:
            literal.append(layout[k])
            k += 1
            continue
        k += len(part[0])
        if part[1] == "OFFSET":
            if k < len(layout):
                raise ValueError("an offset is supported at the end of a layout only")
            offset = True
            break
        if literal:
            out.append("'" + "".join(literal).replace("'", "''") + "'")
            literal = []
        out.append(part[1])
        names |= {"year"} if part[1][0] == "y" else {"month"} if part[1][0] == "M" else {"day"} if part[1][0] == "d" else set()
    rest = "".join(literal).rstrip() if offset else "".join(literal)
    if rest:
        out.append("'" + rest.replace("'", "''") + "'")
    return "".join(out), names, offset
