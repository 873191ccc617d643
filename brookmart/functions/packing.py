"""Texts of a row in one or two columns, for rows that are dealt whole.

Feeds carry numbers, amounts and times as text. :func:`packed` joins the texts of a row in one
column instead of a slot each, and those of ``digits`` (characters ``0-9``, ``.``, ``:``, ``-`` and space)
in a binary column, two characters a byte. A row whose texts hold other characters, or the marks
between them, keeps its columns as they are. :func:`unpacked` gives back exactly the same texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between two texts, and for an absent one.
_NEXT, _NULL = "\x01", "\x02"
#: The same in hexadecimal digits, and what stands for the other characters.
_HEX_NEXT, _HEX_NULL, _MARKS, _HEX_MARKS = "E", "F", "-.: ", "ABCD"


def _digits_code(columns: Sequence[str]) -> Column:
    code = F.concat_ws(_HEX_NEXT, F.lit(""), *[F.coalesce(F.col(c), F.lit(_HEX_NULL)) for c in columns])
    # Of an odd number of digits the first byte has a zero in front, before the first mark.
    return F.when(F.concat_ws("", *columns).rlike(r"\A[0-9.: -]*\z"), F.unhex(F.translate(code, _MARKS, _HEX_MARKS)))


def _text_code(columns: Sequence[str]) -> Column:
    whole = F.concat_ws("", *columns)
    plain = ~F.contains(whole, F.lit(_NEXT)) & ~F.contains(whole, F.lit(_NULL))
    return F.when(plain, F.concat_ws(_NEXT, F.lit(""), *[F.coalesce(F.col(c), F.lit(_NULL)) for c in columns]))


def _split(columns: Sequence[str], digits: Sequence[str], name: str) -> list[tuple[list[str], str]]:
    held = [c for c in columns if c in digits]
    return [(part, part_name) for part, part_name in ((held, f"{name}_digits"), ([c for c in columns if c not in digits], f"{name}_texts")) if part]


def packed(df: DataFrame, columns: Sequence[str], name: str, digits: Sequence[str] = ()) -> DataFrame:
    """``df`` with the text ``columns`` in columns whose names begin with ``name``; where they are in there, they are null."""
    for part, code_name in _split(columns, digits, name):
        coded = df.withColumn(code_name, _digits_code(part) if code_name.endswith("_digits") else _text_code(part))
        df = coded.select(*[F.when(F.col(code_name).isNull(), F.col(c)).alias(c) if c in part else F.col(c) for c in coded.columns])
    return df


def unpacked(df: DataFrame, columns: Sequence[str], name: str, digits: Sequence[str] = ()) -> DataFrame:
    """Undo :func:`packed`, called with the same arguments; rows of an outer join without a match stay null."""
    for part, code_name in _split(columns, digits, name):
        if code_name.endswith("_digits"):
            text, mark, null = F.translate(F.hex(code_name), _HEX_MARKS, _MARKS), _HEX_NEXT, _HEX_NULL
        else:
            text, mark, null = F.col(code_name), _NEXT, _NULL
        values = df.withColumn(code_name, F.split(text, mark))
        value = {c: F.col(code_name)[i + 1] for i, c in enumerate(part)}
        df = values.select(*[
            F.when(F.col(code_name).isNull(), F.col(c)).when(value[c] != null, value[c]).alias(c) if c in part else F.col(c)
            for c in values.columns if c != code_name])
    return df
