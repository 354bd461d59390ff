"""Expansion of ambiguity codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.config import IUPAC


def expand(seq: str, header: str = "", max_ambiguous: int | None = None) -> list[tuple[str, str]]:
    """All sequences a code stands for, with headers; the leftmost code varies slowest.

    Each code adds ``_<letter><place, four digits><base>`` to the header.  More
    codes than ``max_ambiguous`` give nothing; an unknown letter is an error.
    """
    seq = seq.replace("U", "T")
    unknown = set(seq) - set(IUPAC)
    if unknown:
        raise ValueError(f"unknown letter {sorted(unknown)[0]!r}")
    places = [i for i, c in enumerate(seq) if c not in "ACGT"]
    if max_ambiguous is not None and len(places) > max_ambiguous:
        return []
    found = [("", header)]
    for i, c in enumerate(seq):
        tail = (lambda b, c=c, i=i: f"_{c}{i + 1:04d}{b}") if i in places else (lambda b: "")
        found = [(s + b, h + tail(b)) for s, h in found for b in IUPAC[c]]
    return found


def expand_column(df: DataFrame, seq_col: str, out: str = "variant") -> DataFrame:
    """A row for each expansion, for a table of sequences.

    Each letter becomes an array of bases; the arrays are multiplied out.
    """
    codes = F.create_map(*(F.lit(x) for k, v in IUPAC.items() for x in (k, v)))
    letters = F.filter(F.split(F.translate(seq_col, "U", "T"), ""), lambda c: c != "")
    bases = F.transform(letters, lambda c: F.filter(F.split(F.element_at(codes, c), ""), lambda b: b != ""))
    grown = F.aggregate(
        bases,
        F.array(F.lit("")),
        lambda acc, b: F.flatten(F.transform(acc, lambda s: F.transform(b, lambda x: F.concat(s, x)))),
    )
    return df.withColumn(out, F.explode(grown))
