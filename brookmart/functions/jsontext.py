"""Parts of JSON text as text: members and array items keep every digit, blank and order of members.

A parser reads numbers; writing them again loses digits beyond its range and trailing
zeros. These expressions find the place of a part in *well-formed* text by patterns over
strings, scalars and balanced brackets. Patterns use possessive repetition, so they neither
backtrack nor use the stack per letter. What is nested deeper than :data:`DEPTH`, and names
written with escapes, are not found: callers fall back to the parsed value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 8

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_BLANK = r"[ \t\r\n]*+"


def _nested(depth: int) -> str:
    inside = rf'[^{{}}\[\]"]++|{_STRING}' + (f"|{_nested(depth - 1)}" if depth > 1 else "")
    return rf"[{{\[](?:{inside})*+[}}\]]"


_VALUE = rf'(?:{_STRING}|[^{{}}\[\]",\s]++|{_nested(DEPTH)})'


def _before(name: str) -> str:
    """The start of an object up to the value of its member ``name``."""
    key = rf'"{name}"{_BLANK}:'
    other = rf"(?!{key}){_STRING}{_BLANK}:{_BLANK}{_VALUE}{_BLANK},{_BLANK}"
    return rf"\{{{_BLANK}(?:{other})*+{key}{_BLANK}"


def member_or_empty(text: Column, name: str) -> Column:
    """Text of a member's value, of the first member of that name; empty if it is not found."""
    return F.regexp_extract(text, rf"(?s)^{_BLANK}{_before(name)}({_VALUE})", 1)


def member(text: Column, name: str) -> Column:
    """:func:`member_or_empty`, null if it is not found."""
    found = member_or_empty(text, name)
    return F.when(found != "", found)


def items(text: Column) -> Column:
    """Texts of the items of an array; null for other text."""
    bare = F.btrim(text, F.lit(" \t\r\n"))
    inner = F.substring(bare, F.lit(2), F.length(bare) - 2)
    return F.when(bare.startswith("["), F.regexp_extract_all(inner, F.lit(rf"(?s){_VALUE}"), F.lit(0)))


def with_inner_member(text: Column, outer: str, name: str, value: str, old: str) -> Column:
    """Object text with the member ``name`` of its object member ``outer`` changed from ``old`` to ``value``.

    Both are bare texts of strings or numbers. Text that does not hold it comes back unchanged.
    """
    pattern = rf'(?s)^({_BLANK}{_before(outer)}{_before(name)}"?){old}(?=["\s,}}])'
    return F.regexp_replace(text, pattern, f"$1{value}")


def repeated(text: Column, name: str) -> Column:
    """Whether the text holds several members of that name, at any depth."""
    return F.regexp_count(text, F.lit(rf'"{name}"{_BLANK}:')) > 1


def with_members(text: Column, entries: dict[str, Column]) -> Column:
    """Object text with members added at its end; ``entries`` are JSON texts, null ones are left out.

    The object must not hold members of these names.
    """
    bare = F.btrim(text, F.lit(" \t\r\n"))
    body = F.btrim(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit(" \t\r\n"))
    added = [F.concat(F.lit(f'"{name}":'), value) for name, value in entries.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", F.nullif(body, F.lit("")), *added), F.lit("}"))


def holds(text: Column, names: tuple[str, ...]) -> Column:
    """Whether a member of one of the names may be in the text, at any depth; escapes in names count as one."""
    return text.rlike(rf'(?:"(?:{"|".join(names)})"{_BLANK}:)|\\u')


def quoted(value: Column) -> Column:
    """JSON text of a string; null stays null."""
    # The brackets of the list stand outside the quotes of its item.
    return F.when(value.isNotNull(), F.btrim(F.to_json(F.array(value)), F.lit("[]")))
