"""Random streams as column expressions.

A stream is the multiplicative generator x -> 16807 x mod (2^31 - 1). Every table
reserves a fixed number of draws per row, so draw ``k`` of row ``i`` is
``seed * 16807^((i - 1) * reserved + k)``: a value that any task can compute for
any row on its own. The power of the row number is a product of table look-ups on
its base-256 digits; all streams that reserve the same number of draws share it,
and each draw then costs one multiplication. Products stay below 2^62.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from starmill.generator.words import ALPHABET, STREAMS

MODULUS = 2**31 - 1
MULTIPLIER = 16807
DIGIT_BITS = 8
DIGITS = 5  # rows up to 2^40


def _array_text(values: list[int]) -> str:
    return f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)"


def long_array(values: list[int]) -> Column:
    """Array literal; written as one string, which the optimizer folds to a constant."""
    return F.expr(_array_text(values))


@lru_cache(256)
def _powers(step: int, digit: int) -> str:
    """Array literal of the powers of ``step`` by the values of a digit of the row number."""
    base, table, power = pow(step, 1 << (DIGIT_BITS * digit), MODULUS), [], 1
    for _ in range(1 << DIGIT_BITS):
        table.append(power)
        power = power * base % MODULUS
    return _array_text(table)


def word_array(values: list[str]) -> Column:
    """Array literal of words, none of which holds a tilde; folded like the number arrays."""
    return F.expr(f"split('{'~'.join(values)}', '~')")


def jump(row: Column, reserved: int) -> Column:
    """16807^((row - 1) * reserved) mod (2^31 - 1) for a one-based row number."""
    step = pow(MULTIPLIER, reserved, MODULUS)
    skip = F.when(row <= 1 << (DIGIT_BITS * DIGITS), row - 1).otherwise(
        F.raise_error(F.lit("row numbers go up to 2^40")).cast("bigint"))
    product: Column | None = None
    for digit in range(DIGITS):
        index = F.shiftright(skip, DIGIT_BITS * digit).bitwiseAND((1 << DIGIT_BITS) - 1)
        factor = F.get(F.expr(_powers(step, digit)), index.cast("int"))
        product = factor if product is None else product * factor % MODULUS
    return product


def draw(stream: str, jumped: Column, k: int) -> Column:
    """Draw ``k`` (from 1) of the row whose power is ``jumped``."""
    constant = STREAMS[stream][0] * pow(MULTIPLIER, k, MODULUS) % MODULUS
    return jumped * constant % MODULUS


def draw_at(stream: str, jumped: Column, k: Column, largest: int, stride: int = 1,
            first: int = 0) -> Column:
    """Draw ``first + stride * k`` for a column ``k`` in 1..largest."""
    seed = STREAMS[stream][0]
    constants = [
        seed * pow(MULTIPLIER, first + stride * i, MODULUS) % MODULUS
        for i in range(1, largest + 1)
    ]
    return jumped * F.get(long_array(constants), (k - 1).cast("int")) % MODULUS


def uniform(value: Column, low: int | Column, high: int | Column) -> Column:
    """Integer in [low, high], by truncating a double product."""
    if isinstance(low, int):
        low = F.lit(low)
    span = (high - low + 1).cast("double")
    return (low + (value / F.lit(float(MODULUS)) * span).cast("bigint")).cast("bigint")


def pick(value: Column, weighted: list[tuple[str, int]] | list[str]) -> Column:
    """Weighted choice: the first word whose running weight reaches the draw."""
    return F.get(word_array(expanded(weighted)),
                 (uniform(value, 1, total_weight(weighted)) - 1).cast("int"))


def pick_index(value: Column, size: int) -> Column:
    """Zero-based choice among ``size`` equally weighted words."""
    return uniform(value, 1, size) - 1


def expanded(weighted: list) -> list[str]:
    """The word for each value of the draw."""
    return [w for entry in weighted
            for w in ([entry] if isinstance(entry, str) else [entry[0]] * entry[1])]


def total_weight(weighted: list) -> int:
    return len(expanded(weighted))


def alphanumeric(stream: str, jumped: Column, average: int) -> Column:
    """Random string of 0.4 to 1.6 times the average length, five characters per draw.

    The draw covers a range that overflows 32 bits to -2^31, so the value is negative
    and its low six-bit groups are those of a two's complement number.
    """
    low, high = int(average * 0.4), int(average * 1.6)
    alphabet = word_array(list(ALPHABET))
    characters = []
    for group in range((high + 4) // 5):
        value = (draw(stream, jumped, group + 2) / F.lit(float(MODULUS))
                 * F.lit(-float(2**31))).cast("bigint")
        for position in range(5):
            code = F.shiftright(value, 6 * position).bitwiseAND(63)
            characters.append(F.get(alphabet, code.cast("int")))
    length = uniform(draw(stream, jumped, 1), low, high)
    return F.substring(F.concat(*characters), F.lit(1), length.cast("int"))


def phone(stream: str, jumped: Column, nation: Column) -> Column:
    return F.concat_ws(
        "-",
        (nation % 90 + 10).cast("string"),
        uniform(draw(stream, jumped, 1), 100, 999).cast("string"),
        uniform(draw(stream, jumped, 2), 100, 999).cast("string"),
        uniform(draw(stream, jumped, 3), 1000, 9999).cast("string"),
    )
