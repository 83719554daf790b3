"""Bits as longs: bit i of a signature is bit i % 64 of its word i // 64.  Comparing two is a few exclusive ors
and population counts in generated code."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pixkin.functions.transform import let

WORD = 64


def words(bits: int) -> int:
    return -(-bits // WORD)


def pack(bits: np.ndarray) -> np.ndarray:
    """The words of an array of booleans."""
    out = np.zeros(words(len(bits)) * WORD, np.uint8)
    out[: len(bits)] = bits
    return np.packbits(out, bitorder="little").view("<i8")


def packed(bits: Column) -> Column:
    """The words of an array of 0 and 1."""
    one = lambda b, i: F.call_function("shiftleft", b.cast("long"), i)
    word = lambda b, w: F.aggregate(F.transform(F.slice(b, w * WORD + 1, F.lit(WORD)), one), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
    return let(bits, lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.size(b) - 1) / WORD).cast("int")), lambda w: word(b, w)))


def unpacked(signature: Column) -> Column:
    """The bits, as an array of 0 and 1 of whole words."""
    return F.flatten(F.transform(signature, lambda w: F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(w, i).cast("int"))))


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, parts)


def differing(a: Column, b: Column, bits: int) -> Column:
    """How many of the bits differ."""
    return _sum([F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(words(bits))])


def differing_in_runs(a: Column, b: Column, runs: int, bits: int) -> list[Column]:
    """The same for each of `runs` runs of `bits` bits, which are whole words or fit whole into one."""
    other = [F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))) for i in range(words(runs * bits))]
    if bits % WORD == 0:
        n = bits // WORD
        return [_sum([F.bit_count(x) for x in other[i * n : (i + 1) * n]]) for i in range(runs)]
    if WORD % bits:
        raise ValueError("runs of bits must be whole words or divide one")
    mask = F.lit((1 << bits) - 1).cast("long")
    return [F.bit_count(F.shiftright(other[i * bits // WORD], i * bits % WORD).bitwiseAND(mask)) for i in range(runs)]


def run_of_bits(signature: Column, first: int, last: int) -> Column:
    """Bits first to last, less than 64 of them, as a long."""
    word, at, n = first // WORD, first % WORD, last - first
    mask = F.lit((1 << n) - 1).cast("long")
    low = F.call_function("shiftrightunsigned", F.get(signature, F.lit(word)), F.lit(at))
    if at + n > WORD:
        low = low.bitwiseOR(F.shiftleft(F.get(signature, F.lit(word + 1)), WORD - at))
    return low.bitwiseAND(mask)
