"""Path predicates and path parts as column expressions."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

META_SUFFIX = "-meta.xml"
ROOT_MARKERS = frozenset({"", ".", "./"})


class ScopeError(ValueError):
    """Scopes that can't be used; the message names each one."""


def canonical_scopes(scopes: Iterable[str]) -> list[str]:
    """The scopes normalised, each once, in their order; the root is ".".

    ScopeError, naming all of them, for empty scopes, pathspec magic, wildcards, drive letters, absolute paths and
    paths that leave the root.
    """
    kept: dict[str, None] = {}
    refused = []
    for scope in scopes:
        plain = scope.replace("\\", "/")
        bad = not plain.strip() or plain[0] == ":" or plain[0] == "/" or any(c in plain for c in "*?[")
        if bad or re.match(r"[A-Za-z]:", plain) or ".." in plain.split("/"):
            refused.append(scope)
        else:
            kept[posixpath.normpath(plain).rstrip("/") or "."] = None
    if refused:
        raise ScopeError("unusable scopes: " + ", ".join(map(repr, refused)))
    return list(kept)


def in_scope(path: Column, scopes: Iterable[str]) -> Column:
    """Whether the path is one of the scopes or below one; no scope at all lets nothing in, a root marker everything."""
    out = F.lit(False)
    for scope in scopes:
        if scope in ROOT_MARKERS:
            return F.lit(True)
        out = out | (path == scope) | path.startswith(f"{scope}/")
    return out


def pathspec_regex(spec: str) -> str | None:
    """The Java pattern of a pathspec in which * crosses directories and ? is one character.

    None for a spec with "[": character classes aren't supported and match nothing.
    """
    plain = re.sub(r"^(\./|/)+", "", spec)
    if "[" in plain:
        return None
    if not any(c in plain for c in "*?"):
        return f"^{re.escape(plain)}(/.*)?$" if plain not in ROOT_MARKERS else "^"
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in plain) + "$"


def matches_pathspec(path: Column, specs: Iterable[str]) -> Column:
    """Whether any of the pathspecs matches."""
    out = F.lit(False)
    for pattern in filter(None, map(pathspec_regex, specs)):
        out = out | path.rlike(pattern)
    return out


def parts(path: Column) -> Column:
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """All before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(name: Column) -> Column:
    """A file name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def without_meta(name: Column) -> Column:
    return F.regexp_replace(name, r"-meta\.xml$", "")


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, the meta suffix aside; the whole name without a dot."""
    return F.substring_index(F.regexp_replace(base_name(path), r"-meta\.xml", ""), ".", -1)


def last_index(array: Column, value: Column) -> Column:
    """The last place, from 1, of a value in an array; 0 without it or for a null value."""
    back = F.array_position(F.reverse(array), value)
    return F.coalesce(F.when(back > 0, F.size(array) - back + 1).otherwise(0), F.lit(0)).cast("int")


def joined(array: Column, start: Column | int, length: Column) -> Column:
    """length elements from start on, joined by slashes; empty for a length under 1."""
    return F.array_join(F.slice(array, F.lit(start) if isinstance(start, int) else start, F.greatest(length, F.lit(0))), "/")


def ancestors(path: Column) -> Column:
    """The directories above a path, the outermost first."""
    p = parts(path)
    return F.when(F.size(p) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/")))
