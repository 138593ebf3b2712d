"""Recognised tokens, parsed by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rhythm import by_name

#: Fixed values.
KERN = {"0": "whole", "1": "whole", "2": "half", "4": "quarter", "8": "eighth", "16": "sixteenth", "32": "thirty_second"}
LIFT = {"#": "sharp", "##": "double_sharp", "N": "natural", "b": "flat", "bb": "double_flat"}
BARLINES = ("barline", "doublebarline", "bolddoublebarline", "repeatStart", "repeatEnd", "repeatEndStart")


def note_token(token: Column) -> dict[str, Column]:
    """is_rest, duration (null if the token has no usable one), dotted and grace of a ``note_`` or ``rest_`` token."""
    is_rest = F.startswith(token, F.lit("rest_"))
    suffix = F.substr(token, F.lit(6))
    many = is_rest & F.endswith(suffix, F.lit("m"))
    grace = F.contains(suffix, F.lit("G"))
    base = F.when(grace, F.regexp_replace(suffix, "^([^G]*)G", "$1")).otherwise(suffix)
    dotted = F.endswith(base, F.lit("."))
    number = F.regexp_replace(base, r"\.$", "")
    duration = F.when(many, "whole").when(F.endswith(suffix, F.lit("..")), None).otherwise(by_name(number, KERN))
    return {"is_rest": is_rest, "duration": duration, "dotted": dotted & ~many, "grace": grace & ~many}


def clef_token(token: Column) -> tuple[Column, Column]:
    """Sign and line; both null if the token is none."""
    ok = token.rlike(r"^clef_[GFC][0-9]+$")
    return F.when(ok, F.substring(token, 6, 1)), F.when(ok, F.substr(token, F.lit(7)).cast("int"))


def key_token(token: Column) -> Column:
    return F.regexp_extract(token, r"^keySignature_(-?[0-9]+)$", 1).try_cast("int")


def time_token(token: Column) -> Column:
    return F.regexp_extract(token, r"^timeSignature/([0-9]+)$", 1).try_cast("int")


def accidental(lift: Column) -> Column:
    return by_name(lift, LIFT)


def token_class(token: Column) -> Column:
    return F.when(token.isin(*BARLINES), "bar").when(token == "chord", "chord").when(F.startswith(token, F.lit("note_")) | F.startswith(token, F.lit("rest_")), "note").otherwise("other")
