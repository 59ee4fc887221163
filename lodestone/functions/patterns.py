"""Reading regular expressions: texts that every match must hold, and patterns that are sure to compile."""

from __future__ import annotations

import re

#: Characters that a required text has at least.
GRAM = 3

_PLAIN = re.compile(r"[^\\\[\](){}.*+?^$|]")
_TIMES = re.compile(r"([*+?]|\{(\d+)(?:,\d*)?\})[?+]?")
_CLASS = re.compile(r"\[\^?(?:[^\]\[\\&]|\\.)(?:[^\]\[\\&]|\\.)*\]", re.S)


class Unknown(Exception):
    """A construct that isn't read; the pattern counts as one without a required text."""


def _best(found: list[frozenset[str]]) -> frozenset[str] | None:
    """Of several sets that all must be met, the one whose shortest text is longest."""
    found = [s for s in found if min(map(len, s)) >= GRAM]
    return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _element(p: str, at: int) -> tuple[str | None, str | None, frozenset[str] | None, int]:
    """What stands at `at`: its kind (None: a place, which takes no character), the character it must hold, the texts of which a group requires one, and where it ends."""
    c = p[at]
    if c in "^$":
        return None, None, None, at + 1
    if c == "\\":
        if at + 1 >= len(p):
            raise Unknown
        e = p[at + 1]
        at += 2
        if e in "bBAzZG":
            return None, None, None, at
        if e in "pP" and p[at : at + 1] == "{" and "}" in p[at:]:
            return "set", None, None, p.index("}", at) + 1
        if e.isalnum():
            if e not in "dDwWsS":
                raise Unknown
            return "set", None, None, at
        return "text", e, None, at
    if c == "(":
        if p.startswith("(?", at) and not p.startswith("(?:", at):
            raise Unknown
        inner, at = _either(p, at + (3 if p.startswith("(?:", at) else 1))
        if p[at : at + 1] != ")":
            raise Unknown
        return "group", None, inner, at + 1
    if c == "[":
        m = _CLASS.match(p, at)
        if not m:
            raise Unknown
        return "set", None, None, m.end()
    if c == ".":
        return "set", None, None, at + 1
    if _PLAIN.match(c):
        return "text", c, None, at + 1
    raise Unknown


def _least(times: re.Match | None) -> int:
    """How often an element stands at least."""
    return 1 if not times else {"*": 0, "?": 0, "+": 1}.get(times[1], int(times[2] or 0))


def _branch(p: str, at: int) -> tuple[frozenset[str] | None, int]:
    """The texts required by one alternative from `at` on, and where it ends."""
    run, found = "", []

    def close():
        nonlocal run
        if run:
            found.append(frozenset([run]))
        run = ""

    while at < len(p) and p[at] not in "|)":
        kind, text, inner, at = _element(p, at)
        if not kind:
            continue
        times = _TIMES.match(p, at)
        if times:
            at = times.end()
        at_least = _least(times)
        if text and at_least:
            run += text
            if times:
                close()
        else:
            close()
            if inner and at_least:
                found.append(inner)
    close()
    return _best(found), at


def _either(p: str, at: int) -> tuple[frozenset[str] | None, int]:
    """The texts of which one is required by alternatives from `at` on."""
    parts = []
    while True:
        texts, at = _branch(p, at)
        parts.append(texts)
        if p[at : at + 1] != "|":
            break
        at += 1
    return (None if None in parts else frozenset().union(*parts)), at


def required(pattern: str) -> frozenset[str] | None:
    """Texts of GRAM characters or more of which every match holds at least one; nothing where none are known.

    Flags, look-around, back references, quotations and nested classes are not read: such patterns have none.
    """
    try:
        texts, at = _either(pattern, 0)
        return texts if at == len(pattern) else None
    except Unknown:
        return None


def at_the_end(pattern: str) -> str:
    """The pattern with a closing $ as \\z, as the patterns' own dialect doesn't let it match before a final line break."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\$$", r"\1\\z", pattern)


def lean(pattern: str) -> str:
    """A pattern that is found in the same values: without what may be missing at either end, where it can match nothing.

    Only patterns that are read in full and have no alternatives of their own are made leaner.
    """
    spans, at = [], 0
    try:
        while at < len(pattern) and pattern[at] not in "|)":
            kind, _, _, end = _element(pattern, at)
            times = _TIMES.match(pattern, end) if kind else None
            end = times.end() if times else end
            spans.append((at, end, kind and not _least(times) and not (times[0][-1] == "+" and times[0] != "+")))
            at = end
    except Unknown:
        return pattern
    needed = [s for s in spans if not s[2]]
    return pattern[needed[0][0] : needed[-1][1]] if at == len(pattern) and needed else pattern


_SAFE_CLASS = re.compile(r"\[\^?(?:([0-9A-Za-z])-([0-9A-Za-z])|[0-9A-Za-z .,_/:;@#%=!<>~\"'])+\]")


def sound(pattern: str) -> bool:
    """Whether a pattern is sure to compile: it is read in full and has no repeat counts, properties or unusual classes."""
    if "{" in pattern or r"\p" in pattern or r"\P" in pattern:
        return False
    try:
        if _either(pattern, 0)[1] != len(pattern):
            return False
    except Unknown:
        return False
    classes = _CLASS.findall(re.sub(r"\\.", "", pattern))
    return "[" not in re.sub(_CLASS, "", re.sub(r"\\.", "", pattern)) and all(_SAFE_CLASS.fullmatch(c) and all(a <= b for a, b in re.findall(r"(\w)-(\w)", c)) for c in classes)
