"""Phones of the TIMIT alphabet as labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.labels import MASK

# Phones by the way they are voiced, in their usual order.
VOICED = (
    "b bcl d dcl g gcl dx z zh v dh em en eng nx l r w y hv el iy ih eh ey ae aa aw ay ah ao oy ow uh uw ux er ax ix "
    "axr ax-h"
).split()
UNVOICED = "p pcl t tck k kcl tcl q jh ch s sh f th m n ng hh".split()
PAUSES = "pau epi".split()
SILENCE = "h#"


def phone_mask(phone: Column) -> Column:
    """The label mask of a phone; 0 for an unknown one."""
    speech = MASK["speech"] | MASK["pureSpeech"]
    p = F.lower(F.trim(phone))
    return (
        F.when(p.isin(VOICED), speech | MASK["voiced"])
        .when(p.isin(UNVOICED), speech | MASK["unvoiced"])
        .when(p.isin(PAUSES), speech | MASK["pause"])
        .when(p == SILENCE, MASK["silence"])
        .otherwise(0)
    )


def phone_code(phone: Column) -> Column:
    """A phone's number in the order voiced, unvoiced, pauses, silence, from 0; -1 if unknown."""
    names = F.array(*[F.lit(p) for p in [*VOICED, *UNVOICED, *PAUSES, SILENCE]])
    return F.array_position(names, F.lower(F.trim(phone))).cast("long") - 1


def phone_name(code: Column) -> Column:
    """The phone of a number; null for none."""
    names = F.array(*[F.lit(p) for p in [*VOICED, *UNVOICED, *PAUSES, SILENCE]])
    return F.when(code >= 0, F.get(names, code.cast("int")))
