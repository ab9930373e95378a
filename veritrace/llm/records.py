"""What a record says, apart from how it is written: shared by the duplicate and overlap operators."""

from __future__ import annotations

import json
import re

#: Characters that are words by themselves: Han ideographs.
HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_WORD = re.compile(f"[{HAN}]|[^\\W_{HAN}]+")
_MARK = "\x02"
_BARE = re.compile(r"[\W_]+")


def _walk(node, out: list[str]) -> None:
    if isinstance(node, _Fields):
        out.append(_MARK + "{")
        for key, value in sorted(node, key=lambda kv: (_BARE.sub("", kv[0].casefold()), repr(kv[1]))):
            out.append(key)
            _walk(value, out)
        out.append(_MARK + "}")
    elif isinstance(node, list):
        out.append(_MARK + "[")
        for item in node:
            _walk(item, out)
        out.append(_MARK + "]")
    else:
        out.append({None: "null", True: "true", False: "false"}.get(node, node) if not isinstance(node, str) else node)


class _Fields(tuple):
    """An object's fields, repeated names included."""


def leaves(content: str) -> list[str]:
    """The strings of a record in canonical order, with marked brackets as strings of their own around objects and lists.

    JSON is decoded (numbers keep their digits) and each object's fields are put in the order of their bare names; a
    text that isn't a JSON object or list is one leaf. Nesting too deep to decode counts as text.
    """
    head = content.lstrip("﻿ \t\r\n")[:1]
    if head in ("[", "{"):
        try:
            out: list[str] = []
            _walk(json.loads(content.lstrip("﻿"), object_pairs_hook=_Fields, parse_int=str, parse_float=str, parse_constant=str, strict=False), out)
            return out
        except (ValueError, RecursionError):
            pass
    return [content]


def bare_key(content: str) -> bytes:
    """Equal for two records exactly if they agree once case, white space, punctuation, JSON spelling and field order are disregarded."""
    return "\x00".join(x if x[:1] == _MARK else _BARE.sub("", x.casefold()) for x in leaves(content)).encode("utf-8", "surrogatepass")


def words(content: str) -> list[str]:
    """Case-folded words in canonical order; a Han character is a word."""
    return _WORD.findall("\n".join(leaves(content)).casefold())
