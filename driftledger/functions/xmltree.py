"""XML documents as rows of children, and back.

A child's value is a JSON text: attributes under "@_name", comments under "#comment", text under "#text", children under
their tags, several of one tag as a list, an element with text alone as that text, an empty one as {}. Text keeps its
entities as they are written.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A declaration, with quoted strings, and with a subset of declarations and comments in brackets.
_QUOTED = r"\"[^\"]*\"|'[^']*'"
_DECLARATION = rf"<!(\w(?:{_QUOTED}|\[(?:<!--.*?-->|<\?.*?\?>|<(?:{_QUOTED}|[^>\"'])*+>|[^\]<])*+\]|[^\[\"'>])*+)>"
_TOKEN = re.compile(r"<!--(.*?)-->|<!\[CDATA\[(.*?)\]\]>|<\?(.*?)\?>|" + _DECLARATION + r"|<(/?)([^\s/>]+)((?:\s+[^\s=/>]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


class MalformedDocument(ValueError):
    """The text isn't one well-formed element."""


def _closed(node: dict[str, Any]) -> Any:
    text = node.pop("#text", None)
    if text is None:
        return node
    return {**node, "#text": text} if node else text


def _put(parent: dict[str, Any], name: str, value: Any) -> None:
    """Add a child or text to a node: several of one tag are a list, which grows in place, texts are joined."""
    if name not in parent:
        parent[name] = value
    elif name == "#text":
        parent[name] += value
    elif isinstance(parent[name], list):
        parent[name].append(value)
    else:
        parent[name] = [parent[name], value]


def root_children(text: str) -> Iterator[tuple[str, Any]]:
    """(tag, value) for each child of the root, in order, as soon as it is complete; the root itself comes last as
    ("", {"name", "attributes"}). MalformedDocument at the first error, after the children before it."""
    stack: list[tuple[str, dict[str, Any]]] = []
    root, at = None, 0

    for token in _TOKEN.finditer(text):
        between = text[at : token.start()].strip()
        at = token.end()
        if between:
            if not stack or "<" in between:
                raise MalformedDocument(f"unexpected text before position {token.start()}")
            if len(stack) > 1:
                _put(stack[-1][1], "#text", between)
        comment, data, instruction, declaration, closing, name, attributes, empty = token.groups()
        if comment is not None or data is not None:
            if len(stack) > 1:
                _put(stack[-1][1], "#comment" if data is None else "#text", comment if data is None else data)
            elif comment is not None and stack:
                yield "#comment", comment
            continue
        if instruction is not None or declaration is not None:
            continue
        if closing:
            if not stack or stack[-1][0] != name:
                raise MalformedDocument(f"</{name}> closes nothing at position {token.start()}")
            _, node = stack.pop()
            if len(stack) == 1:
                yield name, _closed(node)
            elif stack:
                _put(stack[-1][1], name, _closed(node))
            continue
        if not stack and root is not None:
            raise MalformedDocument("a second root")
        node = {f"@_{a}": b or c for a, b, c in _ATTRIBUTE.findall(attributes)}
        if not stack:
            root = {"name": name, "attributes": node}
        if not empty:
            stack.append((name, node))
        elif len(stack) == 1:
            yield name, node
        elif stack:
            _put(stack[-1][1], name, node)
    if stack or root is None or text[at:].strip():
        raise MalformedDocument("the document ends early" if stack or root is None else "text after the root")
    yield "", root


def children_of(docs: DataFrame, lenient: bool = False) -> DataFrame:
    """(doc, tag, pos, value, error): the children of the roots of docs (doc, content), from position 1 on, and the root itself
    at position 0, its tag empty and its value {"name", "attributes"}.

    Strict: a malformed document gives one row with its error and no others. Lenient: it gives the children before the
    error. Null and empty contents give no rows. Executed where the documents are; one document at a time.
    """
    kind = docs.schema["doc"].dataType.simpleString()

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for doc, content in zip(frame["doc"], frame["content"], strict=True):
                if content is None or not content.strip():
                    continue
                own: list[tuple] = []
                try:
                    for tag, value in root_children(content):
                        own.append((doc, tag, len(own) + 1 if tag else 0, json.dumps(value, ensure_ascii=False), None))
                except MalformedDocument as e:
                    own = own if lenient else [(doc, "", 0, None, str(e))]
                rows += own
            yield pd.DataFrame(rows, columns=["doc", "tag", "pos", "value", "error"])

    return docs.select("doc", F.col("content").cast("string").alias("content")).mapInPandas(parse, f"doc {kind}, tag string, pos long, value string, error string")


def whole_document(text: str | None) -> dict[str, Any]:
    """A document as one value: its root's name, and under it the attributes and children; {} where it isn't one well-formed
    element, is empty or null."""
    try:
        node: dict[str, Any] = {}
        for tag, value in root_children(text or ""):
            if tag:
                _put(node, tag, value)
            else:
                node = {value["name"]: {**value["attributes"], **node}}
        return node
    except MalformedDocument:
        return {}


def whole_documents(docs: DataFrame) -> DataFrame:
    """(doc, value) of docs (doc, content): each document as whole_document has it, as JSON."""
    kind = docs.schema["doc"].dataType.simpleString()

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc": frame["doc"], "value": [json.dumps(whole_document(c), ensure_ascii=False) for c in frame["content"]]})

    return docs.select("doc", F.col("content").cast("string").alias("content")).mapInPandas(parse, f"doc {kind}, value string")


#: What the characters that mark-up is made of are written as.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escaped(text: str) -> str:
    for char, entity in ENTITIES:
        text = text.replace(char, entity)
    return text


def _rendered(tag: str, value: Any, depth: int, escape: bool, out: list[str]) -> None:
    pad = "    " * depth
    if tag == "#comment":
        out.append(f"{pad}<!--{value}-->\n")
    elif isinstance(value, list):
        for one in value:
            _rendered(tag, one, depth, escape, out)
    elif isinstance(value, dict):
        attributes = "".join(f' {k[2:]}="{v}"' for k, v in value.items() if k.startswith("@_"))
        children = [(k, v) for k, v in value.items() if not k.startswith("@_")]
        if not children:
            out.append(f"{pad}<{tag}{attributes}></{tag}>\n")
        elif [k for k, _ in children] == ["#text"]:
            out.append(f"{pad}<{tag}{attributes}>{escaped(str(children[0][1])) if escape else children[0][1]}</{tag}>\n")
        else:
            out.append(f"{pad}<{tag}{attributes}>\n")
            for k, v in children:
                if k == "#text":
                    out.append(f"{pad}    {escaped(str(v)) if escape else v}\n")
                else:
                    _rendered(k, v, depth + 1, escape, out)
            out.append(f"{pad}</{tag}>\n")
    else:
        text = "" if value is None else str(value)
        out.append(f"{pad}<{tag}>{escaped(text) if escape else text}</{tag}>\n")


def render(root: str, attributes: dict[str, str], children: list[tuple[str, Any]], escape: bool = False, trailing_newline: bool = True) -> str:
    """A document: the header, the root with its attributes, and its children, four spaces deeper on each level."""
    out: list[str] = ['<?xml version="1.0" encoding="UTF-8"?>\n']
    named = "".join(f' {k.removeprefix("@_")}="{v}"' for k, v in attributes.items())
    out.append(f"<{root}{named}>" + ("\n" if children else ""))
    for tag, value in children:
        _rendered(tag, value, 1, escape, out)
    out.append(f"</{root}>")
    return "".join(out) + ("\n" if trailing_newline else "")


def rendered_documents(children: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc, content): each document of children (doc, children: array of (tag, value)) under its root, (doc, value) as
    children_of gives it at position 0."""
    kind = children.schema["doc"].dataType.simpleString()
    both = children.join(roots.select("doc", F.col("value").alias("root")), "doc")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for items, root in zip(frame["children"], frame["root"], strict=True):
                r = json.loads(root)
                texts.append(render(r["name"], r["attributes"], [(c["tag"], json.loads(c["value"])) for c in items]))
            yield pd.DataFrame({"doc": frame["doc"], "content": texts})

    return both.mapInPandas(write, f"doc {kind}, content string")
