"""What several operators of this package need: tables in the shared folder, words of long texts, components."""

from __future__ import annotations

import re
from collections.abc import Iterator

from siltstone.functions.tables import discard, stored as written  # noqa: F401
from siltstone.operators.graph import linked as components  # noqa: F401

#: A word: no space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text expression's UTF-8 bytes."""
    step = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: list_reduce(range(8), {step}, xor(c, b)), 4294967295::BIGINT), 4294967295)"


def word_lists(raw: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, a list for each piece of about size bytes, so that long texts need little memory."""
    at, end = 0, len(raw)
    while at < end:
        stop = min(end, at + size)
        if stop < end:
            gap = _GAP.search(raw, stop)
            stop = gap.start() if gap else end
        if words := raw[at:stop].split():
            yield words
        at = stop
