"""Column expressions on sequences and base qualities. All run on the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.config import IUPAC

#: Bases in one packed word: two bits each, in a signed long.
WORD = 31
PAIRS = 0x1555555555555555


def complement(s: Column) -> Column:
    """A to T and C to G both ways; other letters stay."""
    return F.translate(s, "ACGT", "TGCA")


def revcomp(s: Column) -> Column:
    return F.reverse(complement(s))


def revcomp_text(s: str) -> str:
    """As revcomp, and for ambiguity codes too."""
    return s.translate(str.maketrans("ACGTRYKMBDHV", "TGCAYRMKVHDB"))[::-1]


def ambiguous(s: Column) -> Column:
    """How many letters are none of A, C, G and T."""
    return F.char_length(F.translate(s, "ACGT", ""))


def high_quality(q: Column, above: int = 30) -> Column:
    """Bases of a Phred score above ``above``, from the Phred+33 text."""
    return F.regexp_count(q, F.lit(f"[\\x{33 + above + 1:02x}-~]"))


def low_quality(q: Column, below: int = 10) -> Column:
    return F.regexp_count(q, F.lit(f"[!-\\x{33 + below - 1:02x}]"))


def phred(q: Column) -> Column:
    """Scores of all bases."""
    return F.transform(F.filter(F.split(q, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


#: Hex digits of one word of bases, one bit of four for each of A, C, G and T.
NIBBLES = 15
ONES = int("1" * NIBBLES, 16)
ONE_HOT = {"A": 1, "C": 2, "G": 4, "T": 8}


def primer_distance(s: Column, iupac: str, at_end: bool = False) -> Column:
    """Mismatches with the nearest expansion of a primer, at the start or the end; N in a read matches.

    The expansions vary each place by itself, so the nearest takes the best base
    at every place.  Bases are hex digits with one bit set, codes have the bits
    of all they stand for: a place matches if any bit is common.
    """
    n, hits = len(iupac), []
    for i in range(0, n, NIBBLES):
        part = iupac[i : i + NIBBLES]
        mask = int("".join(f"{sum(ONE_HOT[b] for b in IUPAC[c]):x}" for c in part), 16)
        word = F.translate(F.substring(s, i - n if at_end else i + 1, len(part)), "ACGTNRYKMSWBDHV", "1248f0000000000")
        x = F.conv(word, 16, 10).cast("long").bitwiseAND(F.lit(mask))
        x = x.bitwiseOR(F.shiftright(x, 2))
        x = x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(ONES))
        hits.append(F.bit_count(x))
    return (F.lit(n) - reduce(lambda a, b: a + b, hits)).cast("int")


def n_words(length: int) -> int:
    return -(-length // WORD)


def pack(s: Column, words: int) -> Column:
    """Two bits per base, ``words`` longs; what is missing or no base counts as A."""
    digits = F.translate(F.translate(s, "ACGT", "0123"), "NRYKMSWBDHV", "0" * 11)
    return F.array(*(F.conv(F.concat(F.lit("0"), F.substring(digits, i * WORD + 1, WORD)), 4, 10).cast("long") for i in range(words)))


def n_mask(s: Column, words: int) -> Column:
    """Both bits set where the letter is N."""
    digits = F.translate(F.translate(s, "ACGT", "0000"), "N", "3")
    return F.array(*(F.conv(F.concat(F.lit("0"), F.substring(digits, i * WORD + 1, WORD)), 4, 10).cast("long") for i in range(words)))


def hamming(a: Column, b: Column, words: int, mask: Column | None = None) -> Column:
    """Mismatches of two packed sequences of equal length, apart from masked places."""
    terms = []
    for i in range(words):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(PAIRS))
        if mask is not None:
            x = x.bitwiseAND(F.bitwise_not(F.get(mask, F.lit(i))))
        terms.append(F.bit_count(x))
    return reduce(lambda p, q: p + q, terms).cast("int")


def every(s: Column, step: int, start: int) -> Column:
    """The letters at places ``start``, ``start + step``, ... (from 0)."""
    rest = F.substring(s, start + 1, 1 << 30)
    return F.regexp_replace(rest, f"(.).{{0,{step - 1}}}", "$1")


def divide(x: Column, total: Column) -> Column:
    """Safe where the total is 0."""
    return x / (total + F.lit(2.0**-52))


def likelihood(length: Column, d: Column, pe: float) -> Column:
    """Chance of a read with ``d`` errors in ``length`` bases."""
    return F.pow(F.lit(1 - pe), length - d) * F.pow(F.lit(pe / 3), d)


def significant(x: Column, digits: int = 5) -> Column:
    """A number as text of so many significant digits reads it."""
    return F.format_string(f"%.{digits - 1}e", x).cast("double")
