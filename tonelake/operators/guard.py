"""Technical messages that a fallback scorer must leave neutral."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWERS = ["no", "ok", "si", "sí"]
COMMANDS = "abort borra cambia commit delete drop ejecuta kill nuke push run usa".split()
TERMS = "borra crash delete destroy die dump execute exterminio fatal huelga kill abort murió nuke panic".split()
TECHNICAL = "cache database fichero file foregroundstyle git let make operation process temp temporal tertiary test tests var".split()
PHRASES = ["lo vía matar", "lo vá matar", "manipulacion", "restos mortales"]
MARKS = ["--hard", ".foregroundStyle"]


def technical(text: Column, norm: Column) -> Column:
    """True for a message without tokens, a bare answer, a command, or one with technical words."""
    first = F.get(norm, F.lit(0))
    phrase = F.lit(False)
    for p in PHRASES:
        phrase = phrase | F.lower(text).contains(p)
    for m in MARKS:
        phrase = phrase | text.contains(m)
    return F.coalesce(
        (F.size(norm) == 0)
        | ((F.size(norm) == 1) & first.isin(ANSWERS))
        | first.isin(COMMANDS)
        | F.exists(norm, lambda t: t.isin([*TERMS, "git", "make"]))
        | phrase
        | (F.size(F.filter(norm, lambda t: t.isin(TECHNICAL))) >= 2),
        F.lit(True),
    )
