"""Settings that define results, and the primer table."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: Machine epsilon of doubles, added to divisors.
EPS = 2.0**-52

# They must be as they stand for results to be right.
PRIMERS = (
    (1, "TGGCGAACGGGTGAGTAA", "CCGTGTCTCAGTCCCARTG"),
    (2, "ACTCCTACGGGAGGCAGC", "GTATTACCGCGGCTGCTG"),
    (3, "GTGTAGCGGTGRAATGCG", "CCCGTCAATTCMTTTGAGTT"),
    (4, "GGAGCATGTGGWTTAATTCGA", "CGTTGCGGGACTTAACCC"),
    (5, "GGAGGAAGGTGGGGATGAC", "AAGGCCCGGGAACGTATT"),
)
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "K": "GT", "M": "AC", "S": "CG", "W": "AT",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
RANKS = ("domain", "phylum", "class", "order", "family", "genus", "species")
LOADED, LONG, GOOD = "Number of loaded reads", "Number of long reads", "Number of good reads"
MAPPED = "Number of reads mapped to region"
FILTERED = "After low abundance filter"
MATCHED = "Number of reads mathced to DB"
MAX_UNMATCHED = "Count of maximal unmatched read"
ALL_UNMATCHED = "Count of all unmatched read"
GLOBAL_METRICS = (LOADED, LONG, GOOD)
REGION_METRICS = (MAPPED, FILTERED, MATCHED, MAX_UNMATCHED, ALL_UNMATCHED)
# End of fixed values.

DB_KMER_LEN = 160
DB_MISMATCHES = 2
DB_MAX_AMBIGUOUS = 3


@dataclass(frozen=True)
class Primer:
    region: int
    forward: str
    reverse: str


def primers(rows=PRIMERS) -> list[Primer]:
    return [Primer(*r) for r in rows]


@dataclass(frozen=True)
class PrepConfig:
    """Quality control and primer matching."""

    read_len: int = 100
    qual_th: int = 30
    prc_high_qual: float = 0.75
    low10_th: int = 3
    max_num_ns: int = 0
    paired: bool = True
    dest_paired: bool = True
    max_err_in_primer: int = 2
    with_primer: bool = False
    #: Route single ends by the primer at either end; without it they are refused.
    either_end: bool = False
    #: The mate whose qualities the low-quality test of the second mate reads; "r2" is the strict reading.
    r2_low_quality_from: str = "r1"

    def __post_init__(self):
        if self.read_len < 1:
            raise ValueError("read_len must be positive")
        if not self.paired and self.dest_paired:  # single reads can't make pairs
            object.__setattr__(self, "dest_paired", False)
        object.__setattr__(self, "read_len", min(self.read_len, DB_KMER_LEN))


@dataclass(frozen=True)
class AlgoConfig:
    """Matching, pruning and the mixture solve."""

    filter_reads: bool = True
    min_read_freq: float = 1e-4
    min_read_count: int = 2
    pe: float = 0.005
    n_mm_cut: int = 2
    max_num_ns: int = 0
    do_filter: int = 1
    num_reads_matched: int | None = None
    filter_included: bool = True
    read_type: str = "PE"
    tol: float = 5e-7
    num_iter: int = 10000
    zero: float = 1e-10
    #: Prune tiny frequencies every so many iterations; 0 is never, so results don't depend on the clock.
    prune_every: int = 0
    #: Solve samples of more entries by blocks across tasks; none says that a task holds any sample.
    distribute_above: int | None = None
    prob_amp: float = 1.0
    seed: int = 0

    @property
    def halves(self) -> int:
        """Reads of one bacterium in a region: one pair, or two single ends."""
        return 1 if self.read_type == "PE" else 2

    @property
    def const_len(self) -> bool:
        return self.read_type == "SE"


@dataclass(frozen=True)
class ReportConfig:
    min_freq: float = 0.0
    cut_freq_th: float = 1.1
    write_counts: bool = False
    lineage_prefixes: bool = False
    shorten_names: bool = False
    print_resolution: bool = False
    #: Pass frequencies through five significant digits, as text tables do.
    five_digits: bool = False


@dataclass(frozen=True)
class Config:
    prep: PrepConfig = field(default_factory=PrepConfig)
    algo: AlgoConfig = field(default_factory=AlgoConfig)
    report: ReportConfig = field(default_factory=ReportConfig)
    primers: tuple = PRIMERS
    regions: tuple = (1, 2, 3, 4, 5)

    def with_prep(self, **kw) -> Config:
        return replace(self, prep=replace(self.prep, **kw))


def get_config(kmer_len: int | str = 100, **algo) -> Config:
    """Numbers may come as text, as from a command line."""
    return Config(prep=PrepConfig(read_len=int(kmer_len)), algo=AlgoConfig(**algo))


def db_paths(db_dir: str, name: str, read_len: int = DB_KMER_LEN) -> dict[str, str]:
    """Where the parts of a reference database are, by the naming convention."""
    base = db_dir.rstrip("/")
    return {
        "catalog": f"{base}/{name}_unique_up_to_{DB_MAX_AMBIGUOUS}_ambiguous_16S",
        "headers": f"{base}/{name}_unique_up_to_{DB_MAX_AMBIGUOUS}_ambiguous_16S_headers",
        "regions": f"{base}/{name}_unique_up_to_{DB_MAX_AMBIGUOUS}_ambiguous_16S_ffpe5regions_{DB_MISMATCHES}mm_RL{read_len}",
        "taxonomy": f"{base}/taxonomy_db",
    }
