"""YAML of lock files, workflows and task files: a reader by indentation with limits, which says why it refuses a text.

It reads the first document: mappings, sequences, flow collections, quoted and plain scalars, block scalars,
comments, anchors, aliases and merges. Tags and complex keys are refused. Scalars stay text, null is None.
"""

from __future__ import annotations

import re

# No larger text is read, nor one of more anchors and aliases.
MOST_BYTES, MOST_ANCHORS = 2 * 1024 * 1024, 256
DEEPEST = 64
_ANCHOR = re.compile(r"[&*][A-Za-z0-9_]")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#&*!|>'"%@`\[\]{},?:-][^#]*?|[?:-](?=\S)[^#]*?|[^\s#&*!|>'"%@`\[\]{},][^\n]*?)\s*:(?=\s|$)""")
# Up to the closing quote, or to what ends plain text of a flow value, or to the end.
_DOUBLE, _SINGLE, _PLAIN = re.compile(r'(?:[^"\\]|\\.)*+', re.S), re.compile(r"(?:[^']|'')*+"), re.compile(r"(?:[^,\]}\n:]|:(?=[^ ,\]}\n]))*+")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f", "e": "\x1b", "a": "\a", "v": "\v", " ": " ", '"': '"', "\\": "\\", "/": "/", "N": "\x85", "_": "\xa0"}


class Refused(ValueError):
    """A text that is no YAML of this kind, with the line."""


class Reader:
    def __init__(self, text: str):
        if 4 * len(text) > MOST_BYTES and len(text.encode("utf-8", "surrogatepass")) > MOST_BYTES:
            raise Refused(f"larger than {MOST_BYTES} bytes")
        if text.count("&") + text.count("*") > MOST_ANCHORS and len(_ANCHOR.findall(text)) > MOST_ANCHORS:
            raise Refused("too many anchors or aliases")
        self.lines = text.replace("\r\n", "\n").split("\n")
        self.at = 0
        self.anchors: dict[str, object] = {}
        # what peek and key found last, as both are asked several times about a line
        self.seen: tuple[int, str, tuple[int, str]] = (-1, "", (0, ""))
        self.matched: tuple[str | None, re.Match | None] = (None, None)

    def refuse(self, why: str) -> Refused:
        return Refused(f"line {self.at + 1}: {why}")

    def peek(self) -> tuple[int, str] | None:
        """(indent, text) of the next line with something on it; None at the end of the document."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if self.seen[0] == self.at and self.seen[1] is line:
                return self.seen[2]
            body = line.lstrip(" ")
            if not body.strip() or body.startswith("#"):
                self.at += 1
                continue
            if body.startswith("\t"):
                raise self.refuse("a tab indents")
            if line.startswith(("---", "...")) and not line[3:].strip():
                return None
            self.seen = self.at, line, (len(line) - len(body), body)
            return self.seen[2]
        return None

    def document(self) -> object:
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or self.lines[self.at].lstrip().startswith(("#", "%"))):
            self.at += 1
        if self.at < len(self.lines) and self.lines[self.at].startswith("---"):
            self.lines[self.at] = " " * 3 + self.lines[self.at][3:]
        if self.peek() is None:
            return None
        value = self.node(0, 0)
        if (more := self.peek()) is not None:
            raise self.refuse(f"unexpected {more[1][:20]!r}")
        return value

    def node(self, least: int, depth: int) -> object:
        """The value that begins on the next line, at an indent of least or more."""
        if depth > DEEPEST:
            raise self.refuse("nested too deeply")
        found = self.peek()
        if found is None or found[0] < least:
            return None
        indent, body = found
        if body == "-" or body.startswith("- "):
            return self.sequence(indent, depth)
        if self.key(body):
            return self.mapping(indent, depth)
        self.at += 1
        return self.value(body, indent, depth, least)

    def key(self, body: str) -> re.Match | None:
        if self.matched[0] is not body:
            other = body.startswith(("[", "{", "&", "*", "!")) and not re.match(r"\*\w+\s*:", body)
            self.matched = body, None if other else _KEY.match(body)
        return self.matched[1]

    def sequence(self, indent: int, depth: int) -> list:
        out: list = []
        while (found := self.peek()) is not None and found[0] == indent and (found[1] == "-" or found[1].startswith("- ")):
            rest = found[1][1:].lstrip(" ")
            inner = indent + len(found[1]) - len(rest)
            if not rest or rest.startswith("#"):
                self.at += 1
                out.append(self.node(indent + 1, depth + 1))
            elif rest == "-" or rest.startswith("- ") or self.key(rest):
                self.lines[self.at] = " " * inner + rest  # the entry begins where its text does
                out.append(self.node(inner, depth + 1))
            else:
                self.at += 1
                out.append(self.value(rest, indent, depth + 1, indent + 1))
        if found is not None and found[0] > indent:
            raise self.refuse("indented too far")
        return out

    def mapping(self, indent: int, depth: int) -> dict:
        out: dict = {}
        merged: list[dict] = []
        while (found := self.peek()) is not None and found[0] == indent and (m := self.key(found[1])):
            name = self.scalar(m[1])
            rest = found[1][m.end() :].lstrip(" ")
            self.at += 1
            if not rest or rest.startswith("#"):
                below = self.peek()
                dashes = below is not None and below[0] == indent and (below[1] == "-" or below[1].startswith("- "))
                value = self.node(indent if dashes else indent + 1, depth + 1)
            else:
                value = self.value(rest, indent, depth + 1, indent + 1)
            if name == "<<":
                merged += [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]
            elif name in out:
                raise self.refuse(f"key {name!r} stands twice")
            else:
                out[name] = value
        if found is not None and found[0] > indent:
            raise self.refuse("indented too far")
        if found is not None and found[0] == indent and not (found[1] == "-" or found[1].startswith("- ")):
            raise self.refuse("a key without a colon")
        for more in merged:
            out = more | out
        return out

    def value(self, text: str, indent: int, depth: int, least: int) -> object:
        """A value whose text begins on the line before, after a key or dash of the given indent."""
        first = text[0]
        if first == "!":
            raise self.refuse("tags are not read")
        if first == "&" and (m := re.match(r"&(\S+)\s*(.*)", text)):
            value = self.value(m[2], indent, depth, least) if m[2] and not m[2].startswith("#") else self.node(least, depth + 1)
            self.anchors[m[1]] = value
            return value
        if first == "*" and (m := re.match(r"\*(\S+)\s*(?:#.*)?$", text)):
            if m[1] not in self.anchors:
                raise self.refuse(f"unknown alias {m[1]}")
            return self.anchors[m[1]]
        if first in "|>" and (m := re.match(r"([|>])([+-]?\d?[+-]?)\s*(?:#.*)?$", text)):
            return self.block(m[1], m[2], indent)
        if first in "[{\"'":
            while True:  # flow values and quoted text may go on over lines
                try:
                    value, end = self.flow(text, 0, depth)
                except IndexError:
                    if self.at >= len(self.lines):
                        raise self.refuse("not closed") from None
                    text += "\n" + self.lines[self.at].strip()
                    self.at += 1
                    continue
                if text[end:].strip() and not text[end:].lstrip().startswith("#"):
                    raise self.refuse(f"unexpected {text[end:].strip()[:20]!r}")
                return value
        text = re.split(r"\s#", text, maxsplit=1)[0].rstrip() if "#" in text else text.rstrip()
        while (more := self.peek()) is not None and more[0] > indent and not self.key(more[1]) and not more[1].startswith("- "):
            text += " " + re.split(r"\s#", more[1], maxsplit=1)[0].rstrip()
            self.at += 1
        if ":" in text and re.search(r":(\s|$)", text):
            raise self.refuse("a colon within plain text")
        return self.scalar(text)

    def block(self, style: str, marks: str, indent: int) -> str:
        """A block scalar: lines that are indented further than its key; | keeps line ends, > folds them."""
        rows: list[str] = []
        digit = re.search(r"\d", marks)
        width = indent + int(digit[0]) if digit else None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            body = line.lstrip(" ")
            if body and len(line) - len(body) <= indent:
                break
            if body and width is None:
                width = len(line) - len(body)
            rows.append(line[width:] if width is not None else "")
            self.at += 1
        text = "\n".join(rows)
        if style == ">":
            text = re.sub(r"(?<=\S)\n(?=\S)", " ", text)
        text = text if "+" in marks else text.rstrip("\n")
        return text if "-" in marks or not text else text + "\n"

    def flow(self, text: str, at: int, depth: int) -> tuple[object, int]:
        """(value, place after it) of a flow value; an IndexError says that it goes on beyond the text."""
        if depth > DEEPEST:
            raise self.refuse("nested too deeply")
        at = self.skip(text, at)
        c = text[at]
        if c == "[":
            items: list = []
            at = self.skip(text, at + 1)
            while text[at] != "]":
                value, at = self.flow(text, at, depth + 1)
                at = self.skip(text, at)
                if text[at] == ":":
                    inner, at = self.flow(text, at + 1, depth + 1)
                    value, at = {value: inner}, self.skip(text, at)
                items.append(value)
                at = self.skip(text, at + 1) if text[at] == "," else at
                if text[at - 1] not in ", \n" and text[at] != "]":
                    raise self.refuse("a comma is missing")
            return items, at + 1
        if c == "{":
            found: dict = {}
            at = self.skip(text, at + 1)
            while text[at] != "}":
                name, at = self.flow(text, at, depth + 1)
                at, value = self.skip(text, at), None
                if text[at] == ":":
                    value, at = self.flow(text, at + 1, depth + 1) if text[self.skip(text, at + 1)] not in ",}" else (None, at + 1)
                    at = self.skip(text, at)
                found[str(name)] = value
                if text[at] == ",":
                    at = self.skip(text, at + 1)
                elif text[at] != "}":
                    raise self.refuse("a comma is missing")
            return found, at + 1
        if c in "\"'":
            end = (_DOUBLE if c == '"' else _SINGLE).match(text, at + 1).end()
            if text[end] != c:  # a backslash is the last
                raise IndexError
            value = text[at : end + 1]
            return self.scalar(re.sub(r"\s*\n\s*", " ", value) if "\n" in value else value), end + 1
        end = _PLAIN.match(text, at).end()
        if end + (text[end : end + 1] == ":") >= len(text):
            raise IndexError
        plain = text[at:end].strip()
        if plain.startswith("*") and (m := re.fullmatch(r"\*(\S+)", plain)):
            if m[1] not in self.anchors:
                raise self.refuse(f"unknown alias {m[1]}")
            return self.anchors[m[1]], end
        return self.scalar(plain), end

    def skip(self, text: str, at: int) -> int:
        while text[at] in " \n\t" or text[at] == "#" and text[at - 1] in " \n\t":
            at = text.index("\n", at) if text[at] == "#" and "\n" in text[at:] else at + 1
        return at

    def scalar(self, text: str) -> str | None:
        if text.startswith('"'):
            if len(text) < 2 or not text.endswith('"'):
                raise self.refuse("not closed")

            def plain(m: re.Match) -> str:
                x = m[1]
                return chr(int(x[1:], 16)) if x[0] in "xuU" else _ESCAPES.get(x, x)

            return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", plain, text[1:-1], flags=re.S) if "\\" in text else text[1:-1]
        if text.startswith("'"):
            if len(text) < 2 or not text.endswith("'"):
                raise self.refuse("not closed")
            return text[1:-1].replace("''", "'")
        return None if text in ("", "~", "null", "Null", "NULL") else text


def load(text: str) -> object:
    """The first document of a text as dicts, lists, text and None; Refused, a ValueError, if it cannot be read."""
    return Reader(text).document()
