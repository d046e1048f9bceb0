"""Secret scans: single spans by pattern, and credentials whose parts are only telling together.

A scan finds the base kinds (assign, access, hex), which stand alone, and weak parts, which don't: key identifiers, secret
strings of mixed characters and service endpoints. Weak parts become findings where complementary parts co-occur: the
nearest identifier or endpoint of a secret, in the same scope (a run of lines without a blank one), which alone bounds op8
and masking. That is an interval join of sorted places inside one document, so it needs neither a shuffle nor pairs: the
parts of a batch lie on one axis, scope by scope, and a binary search finds each one's nearest complements.

No text is its own complement. Of what lies inside an endpoint only its user's password and values of queries that are named
as secrets count, as credentials of that endpoint alone; what an identifier's name is given is an identifier and no secret; a
hex run is a secret for identifiers alone, and only where it is a value with a name that isn't one of digests.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_mapper, small_batches, texts_of

BASE_KINDS = ("assign", "access", "hex")
#: Parts that are findings in company only; the complements of each.
WEAK_KINDS = ("key_id", "secret_part", "endpoint")
COMPLEMENTS = {"key_id": ("secret_part", "hex"), "secret_part": ("key_id", "endpoint"), "endpoint": ("secret_part",)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # all of a run of 18 characters or more
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEY_ID = re.compile(r"""\b(?:access|client|account|user|tenant|key)[ _-]?(?:key[ _-]?)?(?:id|name)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""", re.ASCII | re.IGNORECASE)
_ENDPOINT = re.compile(r"""\b(?:https?|wss?|ftp|jdbc:[a-z0-9]+|amqps?|rediss?|mongodb|postgres(?:ql)?|mysql)://[^\s"'<>]+""", re.ASCII | re.IGNORECASE)
_LONG_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}", re.ASCII)
_BLANK = re.compile(r"\n[ \t\r]*\n")
_PASSWORD = re.compile(r"""://[^/?#\s:@]+:([^/?#\s@]{6,})@""", re.ASCII)
_SECRET_NAME = re.compile(r"key|token|secret|signature|sig|passw(?:or)?d|credential|auth", re.ASCII | re.IGNORECASE)
_PARAMETERS = re.compile(r"[^&#;]+")
#: Characters of a value in a query that is a credential, at least.
LEAST_VALUE = 12
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_DIGEST_NAMES = re.compile(r"commit|rev|sha|md5|hash|digest|checksum|etag|blob|tree|uuid|guid", re.IGNORECASE)
#: Bits a character, and changes between letter cases and digits a character, of a random string at least.
LEAST_ENTROPY, LEAST_CHANGES = 3.5, 0.25
_CHANGE = re.compile(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")

_FOUND = "id long, spans array<struct<kind:string,start:int,end:int,linked:int>>"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the kinds that stand alone, leftmost and non-overlapping in each kind, in order of start.

    Offsets are code points. assign: a secret's name, an equals sign or colon and a value of 12 characters or more.
    """
    low = text.lower()
    named = any(name in low for name in _NAMES)  # spares most texts the costliest pattern
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12] if named else []
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


def random_looking(run: str) -> bool:
    """Whether a string mixes cases and digits as random ones do: words joined by case, numbers or slashes don't."""
    if not (any(c.isdigit() for c in run) and any("a" <= c <= "z" for c in run) and any("A" <= c <= "Z" for c in run)):
        return False
    entropy = -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values())
    return entropy >= LEAST_ENTROPY and sum(1 for _ in _CHANGE.finditer(run)) >= LEAST_CHANGES * (len(run) - 1)


def weak_parts(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int]]]:
    """(start, end, kind) of the parts that count in company only, and (start, end, start of the endpoint) of the
    credentials inside endpoints."""
    found = [(m.start(1), m.end(1), "key_id") for m in _KEY_ID.finditer(text)]
    taken, inside = [s[:2] for s in found], []
    if "://" in text:
        for m in _ENDPOINT.finditer(text):
            found.append((m.start(), m.end(), "endpoint"))
            taken.append(m.span())
            inside += [(m.start() + a, m.start() + b, m.start()) for a, b in inside_endpoint(m[0])]
    within = _overlap(sorted(taken))
    found += [(m.start(), m.end(), "secret_part") for m in _LONG_RUN.finditer(text) if not within(m.start(), m.end()) and random_looking(m[0])]
    return sorted(found), inside


def inside_endpoint(endpoint: str) -> list[tuple[int, int]]:
    """(start, end) of the credentials in an endpoint, in order: its user's password, and what parameters named as secrets are
    set to. A parameter begins with ?, &, # or ;, and its value ends before &, # or ;. Each character is looked at a few times."""
    found = [m.span(1) for m in _PASSWORD.finditer(endpoint)]
    for m in _PARAMETERS.finditer(endpoint):
        at, end = m.span()
        opened = at > 0  # the part before the first separator needs its question mark
        while (equals := endpoint.find("=", at, end)) >= 0 and end - equals > LEAST_VALUE:
            name = at if opened else endpoint.find("?", at, equals) + 1
            if (opened or name) and _SECRET_NAME.search(endpoint, name, equals):
                found.append((equals + 1, end))
                break
            at, opened = equals + 1, False
    return sorted(found)


def name_of_value(text: str, at: int) -> str:
    """The name that the value at that place is set to, by an equals sign or a colon; empty if there is none."""
    k = at
    k -= text[k - 1 : k] in ('"', "'")
    while text[k - 1 : k] == " ":
        k -= 1
    if text[k - 1 : k] not in (":", "="):
        return ""
    k -= 1
    while text[k - 1 : k] == " ":
        k -= 1
    k -= text[k - 1 : k] in ('"', "'")
    end = k
    while k and text[k - 1] in _NAME_CHARS:
        k -= 1
    return text[k:end]


def _overlap(spans: list[tuple[int, int]]):
    """A function that tells whether a span has a place in common with one of these, sorted by their starts."""
    starts, ends = [s for s, _ in spans], np.maximum.accumulate([e for _, e in spans] or [0]).tolist()

    def meets(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before > 0 and ends[before - 1] > start

    return meets


def _nearest(at: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, among: list[tuple[int, int]], reach: int | None) -> np.ndarray:
    """For each span the start of the nearest of the spans among, by the gap between them, that begins inside [low, high)
    and is at most reach away (None: anywhere in there), else -1."""
    if not among:
        return np.full(len(at), -1)
    starts, ends = np.array(sorted(among), dtype=np.int64).T
    # of the spans that begin before a place, the one that ends last
    last = np.maximum.accumulate(np.where(ends >= np.maximum.accumulate(ends), np.arange(len(ends)), 0))
    right = np.searchsorted(starts, at)
    left = last[np.maximum(right - 1, 0)]
    right = np.minimum(right, len(starts) - 1)
    gap = lambda k: np.maximum(np.maximum(starts[k] - end, at - ends[k]), 0)
    ok = lambda k: (starts[k] >= low) & (starts[k] < high) & (True if reach is None else gap(k) <= reach)
    pick = np.where(ok(left) & (~ok(right) | (gap(left) <= gap(right))), left, right)
    return np.where(ok(pick), starts[pick], -1)


def _as_parts(text: str, found: list[tuple[int, int, str]], weak: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int]]]:
    """What the base findings are for the weak parts near them: (start, end, kind) of identifiers and secrets, and (start,
    end, start of the endpoint) of those inside an endpoint."""
    sites = [(s, e) for s, e, k in weak if k == "endpoint"]
    starts, named = [s for s, _ in sites], _overlap([(s, e) for s, e, k in weak if k == "key_id"])
    out, inside = [], []
    for s, e, kind in found:
        site = bisect_left(starts, s + 1) - 1
        if site >= 0 and sites[site][1] > s:
            inside += [(s, e, sites[site][0])] * (kind == "assign")
        elif kind == "hex":
            name = name_of_value(text, s)
            if name and not _DIGEST_NAMES.search(name) and not named(s, e):
                out.append((s, e, "hex"))
        else:
            out.append((s, e, "key_id" if kind == "access" else "secret_part"))
    return out, inside


def _scan_rows(batch: pa.RecordBatch, reach: int | None) -> pa.RecordBatch:
    spans: list[list[dict]] = []
    parts: list[tuple[int, int, int, int, str, int, int]] = []  # place, row, start, end, kind, low and high of its scope
    base = 0
    for row, text in enumerate(texts_of(batch)):
        found = base_spans(text) if text else []
        own = {(s, e, k): None for s, e, k in found}
        weak, inside = weak_parts(text) if text else ([], [])
        if weak:
            of_base, more = _as_parts(text, found, weak)
            cuts = [0, *(m.end() for m in _BLANK.finditer(text)), len(text) + 1]
            for r, some in ((row, weak), (-1, of_base)):
                scope = np.searchsorted(cuts, [s for s, _, _ in some], side="right") - 1
                parts += [(base + s, r, s, e, k, base + cuts[c], base + cuts[c + 1]) for (s, e, k), c in zip(some, scope.tolist(), strict=True)]
            base += len(text) + 2
            ends = {s: e for s, e, k in weak if k == "endpoint"}
            own |= {(s, e, "secret_part"): site for s, e, site in inside}
            own |= {(site, ends[site], "endpoint"): s for s, _, site in reversed(inside + more)}
        spans.append(own)
    places = {k: [(p[0], p[0] + p[3] - p[2]) for p in parts if p[4] == k] for k in (*WEAK_KINDS, "hex")}
    for kind in WEAK_KINDS:
        own = [p for p in parts if p[4] == kind and p[1] >= 0]
        if own:
            at, low, high = (np.array([p[c] for p in own], dtype=np.int64) for c in (0, 5, 6))
            end = at + np.array([p[3] - p[2] for p in own], dtype=np.int64)
            near = _nearest(at, end, low, high, [x for c in COMPLEMENTS[kind] for x in places[c]], reach)
            for p, place in zip(own, near.tolist(), strict=True):
                if place >= 0:
                    spans[p[1]].setdefault((p[2], p[3], kind), place - p[0] + p[2])
    spans = [[{"kind": k, "start": s, "end": e, "linked": to} for (s, e, k), to in own.items()] for own in spans]
    order = {k: n for n, k in enumerate((*BASE_KINDS, *WEAK_KINDS))}
    for found in spans:
        found.sort(key=lambda s: (s["start"], order[s["kind"]]))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("linked", pa.int32())]))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = None) -> DataFrame:
    """(id_col, spans): each row's findings in order of start, then kind; start and end in code points, end exclusive.

    kind is one of BASE_KINDS, or of WEAK_KINDS for a weak part with a complement in its scope, between whose nearer ends
    lie at most reach code points (None: any number); linked is then where the nearest starts (null for base kinds). Null and empty texts have no spans; repeated
    rows come back as often as they came. No shuffle; a whole text is looked at, however long.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(arrow_mapper(lambda: lambda b: _scan_rows(b, reach)), _FOUND).withColumnRenamed("id", id_col)


def masked(text: str, mask: str = "[REDACTED]", reach: int | None = None) -> str:
    """The text with every finding, overlapping ones as one, replaced by the mask."""
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([text], pa.string())], names=["id", "text"])
    out, at = [], 0
    for s in _scan_rows(batch, reach).column(1).to_pylist()[0]:
        if s["end"] > at:
            if s["start"] >= at:
                out += [text[at : s["start"]], mask]
            at = s["end"]
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[REDACTED]", reach: int | None = None) -> DataFrame:
    """docs, all rows and columns, with the findings in text_col masked; null stays null."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t and masked(t, mask, reach) for t in batch.column(at).to_pylist()]
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return one

    return docs.mapInArrow(arrow_mapper(make), docs.schema)
