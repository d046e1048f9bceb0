"""Ignore and include rules in gitignore format as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import parts

#: Deletions of record types are never reported: a fixed rule after the user's own.
DESTRUCTIVE_RULE = "recordTypes/"


@dataclass(frozen=True)
class Rule:
    """pattern: a Java pattern for a path from the root, directories with a slash at their end."""

    pattern: str
    keeps: bool


def _segment(text: str) -> str:
    out, k = "", 0
    while k < len(text):
        c = text[k]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := text.find("]", k + 2)) > 0:
            inner = text[k + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner[0] == '!' else inner}]"
            k = end
        elif c == "\\" and k + 1 < len(text):
            k += 1
            out += re.escape(text[k])
        else:
            out += re.escape(c)
        k += 1
    return out


def parse_rule(line: str) -> Rule | None:
    """A line of a rules file; None for blank lines and comments.

    "!" takes a path back, a slash at the end names directories only, a slash elsewhere anchors the rule at the root, "**"
    stands for any number of directories. Letters match in either case.
    """
    text = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r\n"))
    if not text or text.startswith("#"):
        return None
    keeps = text.startswith("!")
    text = text[1:] if keeps else text
    only_directories = text.endswith("/")
    text = text.rstrip("/")
    anchored = "/" in text
    pieces = [p for p in text.split("/") if p]
    if not pieces:
        return None
    out = "" if anchored else "(?:.*/)?"
    for k, piece in enumerate(pieces):
        last = k == len(pieces) - 1
        if piece == "**":
            out += ".+" if last else "(?:.*/)?"
        else:
            # a star alone is a name, so that what names all in a directory doesn't name the directory
            out += ("[^/]+" if not piece.strip("*") else _segment(piece)) + ("" if last else "/")
    return Rule(f"(?i)^{out}{'/' if only_directories else '/?'}$", keeps)


def parse_rules(text: str | None) -> list[Rule]:
    """The rules of a file's text, in order; none for null."""
    return [r for r in map(parse_rule, (text or "").splitlines()) if r]


def ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether the rules ignore a path: the last rule that matches decides, and nothing below an ignored directory is
    taken back. Without rules nothing is ignored; a null path isn't either."""
    if not rules:
        return F.lit(False)

    def verdict(prefix: Column) -> Column:
        out = None
        for rule in reversed(rules):
            hit, value = prefix.rlike(rule.pattern), F.lit(not rule.keeps)
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out.otherwise(F.lit(False))

    p = parts(path)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.concat(F.array_join(F.slice(p, F.lit(1), i), "/"), F.when(i < F.size(p), F.lit("/")).otherwise(F.lit(""))))
    return F.coalesce(F.exists(prefixes, verdict), F.lit(False))


def kept(status: Column, path: Column, rules: list[Rule], destructive: list[Rule] | None = None) -> Column:
    """Whether a change stays: deletions by the destructive rules (the others' where there are none) and the fixed one,
    additions and modifications by the rules, anything else always."""
    of_deletion = [*(rules if destructive is None else destructive), parse_rule(DESTRUCTIVE_RULE)]
    return F.when(status == "D", ~ignored(path, of_deletion)).when(status.isin("A", "M"), ~ignored(path, rules)).otherwise(F.lit(True))
