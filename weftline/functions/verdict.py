"""What a strict function says about its input: a value, how much it took, and the error if it refused.

Every decoder comes in two forms.  ``try_f(col)`` gives the struct ``{value, consumed, error, error_class}``; ``f(col)``
gives the value and fails the query on the first refused cell.  Null cells give null verdicts.

Classes: ``corrupt`` (the input breaks its format), ``unsupported`` (valid, but a feature that is refused) and
``incomplete`` (it ends too early, or the output would pass its limit).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORRUPT, UNSUPPORTED, INCOMPLETE = "corrupt", "unsupported", "incomplete"

#: The errors that are not in class `corrupt`.
UNSUPPORTED_ERRORS = ("PresetDictionary", "WindowTooLarge", "DictionaryUnsupported", "LargeWindow", "DepthTooLarge", "LoneSurrogate")
INCOMPLETE_ERRORS = ("Truncated", "NoSpaceLeft")


class Refused(ValueError):
    """A refusal by its error's name."""

    def __init__(self, error: str, offset: int | None = None) -> None:
        super().__init__(error if offset is None else f"{error} at octet {offset}")
        self.error, self.offset = error, offset


def class_of(error: str | None) -> str | None:
    if error is None:
        return None
    return UNSUPPORTED if error in UNSUPPORTED_ERRORS else INCOMPLETE if error in INCOMPLETE_ERRORS else CORRUPT


def refusal(error: Column) -> Column:
    """The class of a column of error names, as a built-in expression."""
    return F.when(error.isNull(), F.lit(None)).when(error.isin(*UNSUPPORTED_ERRORS), UNSUPPORTED).when(error.isin(*INCOMPLETE_ERRORS), INCOMPLETE).otherwise(CORRUPT)


def schema(value: str = "binary") -> str:
    return f"struct<value:{value},consumed:bigint,error:string,error_class:string>"


def unwrap(verdict: Column) -> Column:
    """The verdict's value; a refused cell fails the query with the error's name."""
    return F.when(verdict["error"].isNotNull(), F.raise_error(F.concat(F.lit("refused: "), verdict["error"]))).otherwise(verdict["value"])
