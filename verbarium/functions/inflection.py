"""Column expressions for grammatical person and number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbarium.schemas import ALL_PERSONS, FIRST, PLURAL, SECOND, SINGULAR, THIRD

PLURAL_SLOT = 1
# Slot name -> bit in a slot mask. Person bits keep their own values.
SLOTS = {"First": FIRST, "Second": SECOND, "Third": THIRD, "Plural": PLURAL_SLOT}


def person_bits(digits: Column) -> Column:
    """Bitmask of the persons named by a digit string; '' names all of them.

    Other digits and repeats add nothing.
    """

    def bit(digit: str, value: int) -> Column:
        return F.when(digits.contains(digit), value).otherwise(0)

    return F.when(digits == "", ALL_PERSONS).otherwise(
        bit("1", FIRST) + bit("2", SECOND) + bit("3", THIRD)
    )


def has_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(bit)) != 0


def slot_mask(num: Column, person: Column) -> Column:
    """The table slots that a form fills, as a bitmask; 0 or null for none.

    A plural form fills the plural slot whatever its person says.
    """
    return F.when(num == PLURAL, PLURAL_SLOT).when(
        num == SINGULAR, person.bitwiseAND(F.lit(ALL_PERSONS))
    )
