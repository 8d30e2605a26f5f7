"""Bit-set labels of frames and their predicate algebra, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bit positions of the label schema.
BITS = {
    "noise": 0, "pureSpeech": 1, "noisySpeech": 2, "background": 3, "music": 4, "action": 5, "breath": 6,
    "undefined": 9, "speech": 10, "pause": 11, "voiced": 12, "unvoiced": 13, "male": 14, "female": 15,
    "silence": 17, "short": 18, "sceneBoundary": 19, "speakerBoundary": 20, "noiseBoundary": 21,
    "shotBoundary": 22, "artificialBoundary": 23, "speechSegStart": 24, "speechSegEnd": 25,
}
MASK = {name: 1 << bit for name, bit in BITS.items()}
ALL = 2**31 - 1
NO_TYPE, NO_SPEAKER, NO_SEGMENT = 0, -1, -1

def _mask(*names: str) -> int:
    return sum(MASK[n] for n in names)


SPEECH_FAMILY = _mask(
    "speech", "pureSpeech", "noisySpeech", "male", "female", "voiced", "unvoiced", "pause", "speakerBoundary",
    "speechSegStart", "speechSegEnd",
)
NOISE_FAMILY = _mask("noise", "action", "background", "breath", "music", "undefined", "noiseBoundary")
DETAILED = _mask("music", "action", "background", "breath", "pureSpeech", "noisySpeech", "undefined")
_SILENCE = MASK["silence"]
# Exclusions, opposites and parents of the label schema.
#: For each label those that cannot hold at the same time; others exclude nothing.
EXCLUSIVE = {
    "noise": _SILENCE | SPEECH_FAMILY,
    "pureSpeech": DETAILED ^ MASK["pureSpeech"] | _SILENCE | NOISE_FAMILY,
    "noisySpeech": DETAILED ^ MASK["noisySpeech"] | _SILENCE | NOISE_FAMILY,
    "background": DETAILED ^ MASK["background"] | _SILENCE | SPEECH_FAMILY,
    "action": DETAILED ^ MASK["action"] | _SILENCE | SPEECH_FAMILY,
    "breath": DETAILED ^ MASK["breath"] | _SILENCE | SPEECH_FAMILY,
    "undefined": DETAILED ^ MASK["undefined"] | _SILENCE,
    "speech": _SILENCE | NOISE_FAMILY,
    "voiced": MASK["unvoiced"] | _SILENCE | NOISE_FAMILY,
    "unvoiced": MASK["voiced"] | _SILENCE | NOISE_FAMILY,
    "male": MASK["female"] | _SILENCE | NOISE_FAMILY,
    "female": MASK["male"] | _SILENCE | NOISE_FAMILY,
    "silence": SPEECH_FAMILY ^ MASK["speakerBoundary"] | NOISE_FAMILY,
    "speakerBoundary": _SILENCE | NOISE_FAMILY,
    "noiseBoundary": _SILENCE | SPEECH_FAMILY,
    "speechSegStart": _SILENCE | NOISE_FAMILY,
    "speechSegEnd": _SILENCE | NOISE_FAMILY,
}
OPPOSITE = {
    "noise": MASK["speech"], "speech": MASK["noise"], "pureSpeech": MASK["noisySpeech"], "noisySpeech": MASK["pureSpeech"],
    "voiced": MASK["unvoiced"], "unvoiced": MASK["voiced"], "male": MASK["female"], "female": MASK["male"],
    "silence": MASK["speech"] | MASK["noise"],
}
PARENT = {
    "pureSpeech": "speech", "noisySpeech": "speech", "pause": "speech", "voiced": "speech", "unvoiced": "speech",
    "male": "speech", "female": "speech", "background": "noise", "music": "noise", "action": "noise", "breath": "noise",
    "undefined": "noise",
}


def has_any(mask: Column, types: int) -> Column:
    return mask.bitwiseAND(F.lit(types)) != 0


def has_all(mask: Column, types: int) -> Column:
    return mask.bitwiseAND(F.lit(types)) == types


def matches(mask: Column, types: int, unite: bool = False, without: int = 0) -> Column:
    """The label predicate: any (or all, if ``unite``) of ``types`` and none of ``without``;
    the empty mask always holds."""
    hit = F.lit(True) if types == NO_TYPE else (has_all if unite else has_any)(mask, types)
    return hit if without == NO_TYPE else hit & (mask.bitwiseAND(F.lit(without)) == 0)


def add(mask: Column, types: int) -> Column:
    return mask.bitwiseOR(F.lit(types))


def remove(mask: Column, types: int) -> Column:
    return mask.bitwiseAND(F.lit(ALL ^ types))


def add_exclusive(mask: Column, name: str) -> Column:
    """Adds a label and clears all that exclude it."""
    return add(remove(mask, EXCLUSIVE.get(name, 0)), MASK[name])


def conflicts(mask: Column) -> Column:
    """The labels of a mask that another one of it excludes, as a mask."""
    out = F.lit(0)
    for name, others in EXCLUSIVE.items():
        out = out.bitwiseOR(F.when(has_any(mask, MASK[name]), mask.bitwiseAND(F.lit(others))).otherwise(F.lit(0)))
    return out


def names(mask: Column, separator: str = ",") -> Column:
    """The names of a mask's labels, by ascending bit."""
    parts = [F.when(has_any(mask, MASK[n]), F.lit(n)) for n in sorted(BITS, key=BITS.get)]
    return F.concat_ws(separator, *parts)


def is_opposite(mask: Column, name: str) -> Column:
    """Whether a mask has a label that is the opposite of the named one."""
    return has_any(mask, OPPOSITE.get(name, 0))


def below(mask: Column, of: str) -> Column:
    """Whether a mask has a label that is a subtype of the named one."""
    return has_any(mask, sum(m for n, m in MASK.items() if is_subtype(n, of)))


def is_subtype(name: str, of: str) -> bool:
    """Whether a label is below another in the hierarchy of types."""
    return PARENT.get(name) == of or (PARENT.get(name) is not None and is_subtype(PARENT[name], of))
