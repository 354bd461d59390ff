"""Queries over the driver tables, one or more per operator, with SQL for DuckDB."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.config import IUPAC, AlgoConfig, PrepConfig, ReportConfig, primers
from strandloom.functions import dna, hashing, iupac
from strandloom.operators import match, mixture, qc, refdb, regions, report, solve, stats, taxonomy
from strandloom.plans import fixture
from strandloom.plans.staging import large, own_path, stage
from strandloom.sources import additive, files, sinks, splits

K = fixture.READ_LEN
PREP, ALGO = PrepConfig(read_len=K), AlgoConfig()
MAX_LEN = 2 * K


class Fixture:
    """The stages over the fixture, each built when asked for; those used more than once are written."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        t = fixture.tables(spark, sf_dir)
        self.primers, self.taxonomy, self._tables = t["primers"], t["taxonomy"], t

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # written, so that no query weaves their expressions into its own
    @cached_property
    def ref(self):
        return stage(self._tables["ref"], "fx-ref")

    @cached_property
    def reads(self):
        return stage(self._tables["reads"], "fx-reads")

    @property
    def uni(self):
        return qc.unique_reads(qc.good_reads(self.reads, PREP))

    @property
    def assigned(self):
        return regions.assign(self.uni, PREP)

    @property
    def region_reads(self):
        return regions.collapse(self.assigned)

    @cached_property
    def kept_reads(self):
        return stage(match.abundant(self.region_reads, ALGO), "kept-reads")

    @cached_property
    def kmers(self):
        return refdb.kmers(self.ref)

    @property
    def matches(self):
        return match.matches(self.kept_reads, self.kmers, ALGO, MAX_LEN)

    # bacteria that no region tells apart are matched and pruned as one, the least of them; ``each`` gives all
    @cached_property
    def classes(self):
        return stage(refdb.classes(self.ref), "classes")

    @cached_property
    def least(self):
        return stage(refdb.least_members(self.ref, self.classes), "least-members")

    def each(self, rows):
        return refdb.each_member(rows, self.classes)

    @cached_property
    def lik(self):
        return stage(match.likelihoods(self.matches, refdb.bact_kmers(self.least, self.kmers), ALGO), "likelihoods")

    @property
    def norm(self):
        return refdb.amplified(self.least)

    def kept(self, lik, cfg=ALGO):
        return solve.present_everywhere(lik, self.least, self.norm, cfg)

    @cached_property
    def groups(self):
        return stage(self.each(solve.ambiguity_groups(self.lik, self.kept(self.lik))), "groups")

    @cached_property
    def system(self):
        pruned = solve.without_included(solve.supports(self.lik, self.groups), ALGO)
        return stage(solve.assemble(pruned, self.lik), "system")

    def frequencies(self, steps: int = 2):
        """After a fixed number of updates, so that SQL can say the same."""
        x = solve.em_init(self.system)
        for _ in range(steps):
            x = solve.em_step(self.system, x)
        return stage(solve.frequencies(x, self.system, ALGO), "frequencies")

    @cached_property
    def found(self):
        freq = self.frequencies()
        return stage(freq.join(solve.assigned_reads(self.system, freq), ["sample", "col"]).withColumnRenamed("col", "group_id"), "found")

    @property
    def members(self):
        return self.groups.select("sample", F.col("representative").alias("group_id"), "bact_id")

    @cached_property
    def top(self):
        return stage(taxonomy.majority(taxonomy.levels(self.members, self.taxonomy), self.found, 7), "top")


def _path(c="path"):
    return F.array_join(c, "/")


def _file_names(fx: Fixture) -> DataFrame:
    """Names of read files, some of them not of the right form."""
    n = F.col("l_orderkey")
    stem = F.concat(F.lit("RDB"), (n % 7).cast("string"), F.lit("_"), F.upper(F.substring(F.md5((n % 50).cast("string")), 1, 6)))
    name = F.concat(
        stem,
        F.when(n % 11 == 0, "_R5").otherwise(""),
        F.lit("_L00"),
        (F.col("l_linenumber") % 4 + 1).cast("string"),
        F.when(n % 5 == 0, "_X").otherwise(""),
        F.lit("_R"),
        (F.col("l_partkey") % 3 + 1).cast("string"),
        F.lit("_001.fastq.gz"),
    )
    return fx.table("lineitem").select(F.concat(F.lit("d"), (n % 50).cast("string")).alias("dir"), name.alias("name")).distinct()


_NAMES = """names AS (SELECT DISTINCT concat('d', l_orderkey % 50) AS dir, concat('RDB', l_orderkey % 7, '_', upper(substr(md5(CAST(l_orderkey % 50 AS VARCHAR)), 1, 6)),
  CASE WHEN l_orderkey % 11 = 0 THEN '_R5' ELSE '' END, '_L00', l_linenumber % 4 + 1, CASE WHEN l_orderkey % 5 = 0 THEN '_X' ELSE '' END, '_R', l_partkey % 3 + 1, '_001.fastq.gz') AS name
  FROM lineitem),
named AS (SELECT dir, name, CASE WHEN regexp_matches(split_part(name, '_L0', 1), '_R') OR NOT regexp_matches(name, '_L0[^_]*_R') THEN '' ELSE split_part(name, '_L0', 1) END AS sample FROM names)"""


def _variants(rc: bool) -> str:
    out = []
    for p in primers():
        for s, _ in iupac.expand(dna.revcomp_text(p.reverse) if rc else p.forward):
            out.append(f"({p.region}, '{s}')")
    return ", ".join(out)


_LOW = "length(regexp_replace({}, '[^!-*]', '', 'g'))"
_HIGH = "length(regexp_replace({}, '[^@-~]', '', 'g'))"
_RANKS = ("domain", "phylum", "class", '"order"', "family", "genus", "species")
_LEVELS = " UNION ALL ".join(
    f"SELECT sample, group_id, {i} AS level, concat_ws('/', {', '.join(_RANKS[:i])}) AS path, bact_id FROM gt" for i in range(1, 8)
)


def _step(i: int) -> str:
    return f"""t{i} AS (SELECT sample, region, seq, sum(a * x) AS t FROM sy JOIN x{i} USING (sample, col) GROUP BY ALL),
x{i + 1} AS (SELECT sample, col, any_value(x) * sum(a * y / (t + 2.220446049250313e-16)) AS x FROM sy JOIN x{i} USING (sample, col) JOIN t{i} USING (sample, region, seq) GROUP BY sample, col)"""


STAGES = f"""{fixture.duckdb_ctes()},
{_NAMES},
qc AS (SELECT *, length(s1) >= {K} AND length(s2) >= {K} AS is_long,
  length(translate(substr(s1, 1, {K}), 'ACGT', '')) = 0 AND length(translate(substr(s2, 1, {K}), 'ACGT', '')) = 0
  AND {_HIGH.format('q1')} / {K}.0 >= 0.75 AND {_LOW.format('q1')} < 3 AND {_HIGH.format('q2')} / {K}.0 >= 0.75 AS is_good FROM fx_reads),
good AS (SELECT sample, substr(s1, 1, {K}) AS r1, substr(s2, 1, {K}) AS r2 FROM qc WHERE is_long AND is_good),
uni AS (SELECT sample, r1, r2, count(*)::BIGINT AS n FROM good GROUP BY ALL),
ent AS (SELECT *, r1 || {fixture.rc('r2')} AS seq FROM uni),
fv AS (SELECT * FROM (VALUES {_variants(False)}) AS t(region, v)),
rv AS (SELECT * FROM (VALUES {_variants(True)}) AS t(region, v)),
dist AS (SELECT e.sample, e.r1, e.r2, e.seq, e.n, p.region, length(p.fwd) AS lf, length(p.rev) AS lr,
  (SELECT min(hamming(substr(e.seq, 1, length(v)), v)) FROM fv WHERE fv.region = p.region)::INT AS d_forward,
  (SELECT min(hamming(right(e.seq, length(v)), v)) FROM rv WHERE rv.region = p.region)::INT AS d_reverse FROM ent e CROSS JOIN fx_primers p),
reg AS (SELECT sample, region, substr(seq, lf + 1, length(seq) - lf - lr) AS seq, n FROM dist WHERE d_forward <= 2 AND d_reverse <= 2),
reg2 AS (SELECT sample, region, seq, sum(n)::BIGINT AS n FROM reg GROUP BY ALL),
keep AS (SELECT sample, region, seq, n FROM (SELECT *, sum(n) OVER (PARTITION BY sample, region) AS t FROM reg2) WHERE n >= greatest(t * 1e-4, 2)),
km AS (SELECT region, kmer, row_number() OVER (PARTITION BY region ORDER BY kmer) AS kmer_id FROM (SELECT DISTINCT region, kmer FROM fx_ref WHERE kmer IS NOT NULL)),
bk AS (SELECT bact_id, region, kmer_id FROM fx_ref JOIN km USING (region, kmer)),
mt AS (SELECT sample, region, seq, n, kmer_id, kmer, hamming(seq, kmer)::INT AS d FROM keep JOIN km USING (region) WHERE length(seq) = length(kmer) AND hamming(seq, kmer) <= 2),
lik AS (SELECT sample, region, seq, bact_id, any_value(n) AS n, min(d) AS d, sum(pow(0.995, length(seq) - d) * pow(0.005 / 3, d)) AS p, length(seq) AS len
  FROM mt JOIN bk USING (region, kmer_id) GROUP BY sample, region, seq, bact_id),
nrm AS (SELECT bact_id, count(kmer) AS norm FROM fx_ref GROUP BY ALL),
ev AS (SELECT sample, bact_id, region, sum(p) AS mass, count(*) FILTER (d = 0) AS perfect FROM lik GROUP BY ALL),
sb AS (SELECT DISTINCT sample, bact_id FROM lik),
kept AS (SELECT sb.sample, sb.bact_id, any_value(norm) AS norm FROM sb JOIN nrm USING (bact_id) LEFT JOIN (SELECT bact_id, region FROM fx_ref WHERE is_perfect_match) pm USING (bact_id)
  LEFT JOIN ev ON ev.sample = sb.sample AND ev.bact_id = sb.bact_id AND ev.region = pm.region
  WHERE norm > 0 GROUP BY sb.sample, sb.bact_id HAVING bool_and(pm.region IS NULL OR coalesce(perfect, 0) >= 1)),
sig AS (SELECT sample, bact_id, norm, md5(string_agg(concat(region, ':', seq, ':', d), '|' ORDER BY region, seq)) AS sg FROM lik JOIN kept USING (sample, bact_id) GROUP BY ALL),
grp AS (SELECT sample, bact_id, norm, min(bact_id) OVER (PARTITION BY sample, norm, sg) AS representative FROM sig),
spp AS (SELECT lik.sample, lik.region, lik.seq, lik.bact_id AS col, n, d, p, norm FROM lik JOIN grp ON grp.sample = lik.sample AND grp.bact_id = lik.bact_id AND grp.bact_id = representative),
nz AS (SELECT sample, col, count(*) AS nnz FROM spp GROUP BY ALL),
inc AS (SELECT DISTINCT sample, i AS col FROM (SELECT a.sample, a.col AS i, b.col AS j, count(*) AS c FROM spp a JOIN spp b ON a.sample = b.sample AND a.region = b.region AND a.seq = b.seq AND a.col <> b.col GROUP BY ALL) q
  JOIN nz ni USING (sample) JOIN nz nj USING (sample) WHERE ni.col = i AND nj.col = j AND c = ni.nnz AND nj.nnz > ni.nnz),
mtot AS (SELECT sample, sum(n) AS matched FROM (SELECT DISTINCT sample, region, seq, n FROM lik) GROUP BY ALL),
sy AS (SELECT spp.sample, region, seq, spp.col, p / norm AS a, n / matched AS y, norm, p, n FROM spp JOIN mtot USING (sample) WHERE (spp.sample, spp.col) NOT IN (SELECT sample, col FROM inc)),
x0 AS (SELECT sample, col, s / sum(s) OVER (PARTITION BY sample) AS x FROM (SELECT sample, col, sum(a * y) AS s FROM sy GROUP BY ALL)),
{_step(0)},
{_step(1)},
{_step(2)},
fr AS (SELECT sample, col, x / norm / sum(x / norm) OVER (PARTITION BY sample) AS freq FROM x2 JOIN (SELECT DISTINCT sample, col, norm FROM sy) USING (sample, col) WHERE x > 1e-10),
jn AS (SELECT sy.*, p * freq AS j FROM sy JOIN fr USING (sample, col)),
asg AS (SELECT sample, col, sum(r)::BIGINT AS reads FROM (SELECT sample, col, region, round(sum(n * j / (t + 2.220446049250313e-16))) AS r
  FROM jn JOIN (SELECT sample, region, seq, sum(j) AS t FROM jn GROUP BY ALL) USING (sample, region, seq) GROUP BY ALL) GROUP BY ALL),
fnd AS (SELECT sample, col AS group_id, freq, reads FROM fr JOIN asg USING (sample, col)),
gt AS (SELECT sample, representative AS group_id, fx_taxonomy.* FROM grp JOIN fx_taxonomy USING (bact_id)),
lv AS (SELECT sample, group_id, level, path, count(*)::BIGINT AS n_members, md5(string_agg(bact_id, ',' ORDER BY bact_id)) AS hash FROM ({_LEVELS}) GROUP BY ALL),
lv2 AS (SELECT *, n_members / sum(n_members) OVER (PARTITION BY sample, group_id, level) AS fraction FROM lv),
top AS (SELECT sample, group_id, path, freq, round(reads * fraction)::BIGINT AS reads FROM (SELECT *, row_number() OVER (PARTITION BY sample, group_id ORDER BY n_members DESC, path) AS rk FROM lv2 WHERE level = 7)
  JOIN fnd USING (sample, group_id) WHERE rk = 1),
tx AS (SELECT sample, path, sum(freq) AS freq FROM top GROUP BY ALL)"""

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, stages: bool = True):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = f"WITH {STAGES}\n{sql}" if stages else sql
        return f

    return add


@query("SELECT name, sample FROM named")
def q01_sample_names(fx):
    """Sample names from file names."""
    return _file_names(fx).select("name", files.sample_name_column(F.col("name")).alias("sample"))


@query("""SELECT f.dir, f.name AS r1, s.name AS r2 FROM names f LEFT JOIN names s ON s.dir = f.dir AND s.name = replace(f.name, '_R1_', '_R2_') WHERE contains(f.name, '_R1_')""")
def q02_mate_pairing(fx):
    return files.pair_files(_file_names(fx), strict=False)


@query("SELECT dir, count(*)::BIGINT AS n_files, count(*) > 0 AND count(*) % 2 = 0 AS valid FROM names GROUP BY dir")
def q03_sample_validity(fx):
    return files.valid_samples(_file_names(fx))


@query("SELECT DISTINCT dir, sample, replace(name, '_R3', '_R2') AS as_name, max(name) OVER (PARTITION BY dir, sample, replace(name, '_R3', '_R2')) AS name FROM named WHERE sample <> ''")
def q03_flat_names(fx):
    return files.flat_names(_file_names(fx))


@query("SELECT doc_id, substr(text, 1, 100) AS prefix FROM documents WHERE length(text) >= 100", False)
def q04_length_trunc(fx):
    cfg = PrepConfig(read_len=100)
    return fx.table("documents").where(qc.long_enough(F.col("text"), cfg)).select("doc_id", F.substring("text", 1, 100).alias("prefix"))


@query("SELECT doc_id, length(translate(text, 'ACGT', ''))::INT AS n_other FROM documents WHERE length(translate(text, 'ACGT', '')) <= 500", False)
def q05_ambiguity_filter(fx):
    n = dna.ambiguous(F.col("text"))
    return fx.table("documents").where(n <= 500).select("doc_id", n.alias("n_other"))


_MATES = ("q1", "q2")


@query(
    "SELECT sample, pair_key, "
    + ", ".join(f"{_HIGH.format(q)}::INT AS high_{q}, {_LOW.format(q)}::INT AS low_{q}, array_to_string(list_transform(string_split({q}, ''), lambda x: ascii(x) - 33), ',') AS scores_{q}" for q in _MATES)
    + " FROM fx_reads"
)
def q06_phred_stats(fx):
    cols = []
    for q in _MATES:
        scores = F.array_join(F.transform(dna.phred(F.col(q)), lambda x: x.cast("string")), ",")
        cols += [dna.high_quality(F.col(q)).alias(f"high_{q}"), dna.low_quality(F.col(q)).alias(f"low_{q}"), scores.alias(f"scores_{q}")]
    return fx.reads.select("sample", "pair_key", *cols)


@query("SELECT sample, count(*)::BIGINT AS loaded, count(*) FILTER (is_long)::BIGINT AS long, count(*) FILTER (is_long AND is_good)::BIGINT AS good FROM qc GROUP BY sample")
def q07_qc_good_pairs(fx):
    return qc.counts(fx.reads, PREP)


@query("SELECT * FROM uni")
def q08_unique_reads(fx):
    return fx.uni


@query("SELECT sample, r1, '' AS r2, count(*)::BIGINT AS n FROM (SELECT sample, r1 FROM good UNION ALL SELECT sample, r2 FROM good) GROUP BY ALL")
def q09_single_end_stack(fx):
    return qc.unique_reads(qc.good_reads(fx.reads, PrepConfig(read_len=K, dest_paired=False)))


@query(f"SELECT DISTINCT s1, translate(s1, 'ACGT', 'TGCA') AS other, {fixture.rc('s1')} AS turned FROM fx_reads")
def q10_revcomp(fx):
    return fx.reads.select("s1", dna.complement(F.col("s1")).alias("other"), dna.revcomp(F.col("s1")).alias("turned")).distinct()


@query("""SELECT bact_id, region, coded, replace(replace(coded, 'R', x), 'Y', y) AS variant
FROM (SELECT bact_id, region, concat(substr(kmer, 1, bact_id % 12), 'R', substr(kmer, bact_id % 12 + 2, 9), 'Y') AS coded FROM fx_ref WHERE kmer IS NOT NULL)
CROSS JOIN (VALUES ('A'), ('G')) AS p(x) CROSS JOIN (VALUES ('C'), ('T')) AS q(y)""")
def q11_iupac_expand(fx):
    """Reference k-mers with two ambiguity codes put in, spelled out."""
    at = (F.col("bact_id") % 12).cast("int")
    coded = F.concat(F.substring("kmer", F.lit(1), at), F.lit("R"), F.substring("kmer", at + 2, F.lit(9)), F.lit("Y"))
    rows = fx.ref.where("kmer is not null").select("bact_id", "region", coded.alias("coded"))
    return iupac.expand_column(rows, "coded").select("bact_id", "region", "coded", "variant")


@query("SELECT sample, r1, r2, region, d_forward, d_reverse FROM dist")
def q12_primer_distance(fx):
    return regions.distances(fx.uni).select("sample", "r1", "r2", "region", "d_forward", "d_reverse")


@query("SELECT sample, region, seq, n FROM reg")
def q13_region_assign(fx):
    return fx.assigned


@query("SELECT sample, region, count(*)::BIGINT AS n_unique, sum(n)::BIGINT AS n_reads FROM reg2 GROUP BY ALL")
def q14_region_unireads(fx):
    return regions.totals(fx.region_reads)


@query("""SELECT g.sample, g.region, coalesce(n_unique, 0)::BIGINT AS n_unique, coalesce(n_reads, 0)::BIGINT AS n_reads
FROM (SELECT * FROM (SELECT DISTINCT sample FROM fx_reads UNION ALL SELECT 'empty') s CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5])::INT AS region) r) g
LEFT JOIN (SELECT sample, region, count(*) AS n_unique, sum(n) AS n_reads FROM reg2 GROUP BY ALL) t USING (sample, region)""")
def q14_empty_sample(fx):
    """Every sample has every region, one without reads too."""
    samples = fx.reads.select("sample").distinct().unionByName(fx.spark.range(1).select(F.lit("empty").alias("sample")))
    return regions.totals(fx.region_reads, samples)


@query("SELECT * FROM keep")
def q15_abundance_filter(fx):
    return fx.kept_reads


@query("SELECT region, kmer, kmer_id::INT AS kmer_id FROM km")
def q16_ref_kmers(fx):
    return fx.kmers


@query("""SELECT bact_id, region, kmer, count(kmer) OVER (PARTITION BY bact_id) AS norm, round(count(kmer) OVER (PARTITION BY region) / count(*) OVER (PARTITION BY region), 9) AS mean_amplified
FROM (SELECT bact_id, region, CASE WHEN ('0x' || substr(md5(concat('3:', bact_id, ':', region)), 1, 8))::BIGINT / 4294967296.0 < 0.5 / share THEN kmer END AS kmer
  FROM fx_ref CROSS JOIN (SELECT count(kmer) / count(*) AS share FROM fx_ref))""")
def q17_amplified_mean_norm(fx):
    ref = refdb.subsample(fx.ref, 0.5, 3)
    mean = refdb.mean_amplified(ref).select("region", F.round("mean_amplified", 9).alias("mean_amplified"))
    return ref.select("bact_id", "region", "kmer").join(refdb.amplified(ref), "bact_id").join(mean, "region")


@query("SELECT bact_id, min(bact_id) OVER (PARTITION BY sg) AS class_id FROM (SELECT bact_id, string_agg(concat(region, coalesce(kmer, '-'), is_perfect_match), '|' ORDER BY region) AS sg FROM fx_ref GROUP BY bact_id)")
def q18_db_static_classes(fx):
    return refdb.classes(fx.ref)


@query("SELECT sample, region, seq, n, kmer_id::INT AS kmer_id, d FROM mt")
def q19_fuzzy_match(fx):
    return fx.matches.drop("kmer")


@query("SELECT sample, region, seq, bact_id, d, len::INT AS len, round(log10(p), 6) AS log_p FROM lik")
def q20_likelihood(fx):
    return fx.each(fx.lik).select("sample", "region", "seq", "bact_id", "d", "len", F.round(F.log10("p"), 6).alias("log_p"))


@query("""SELECT sample, region, count(*) FILTER (hit)::BIGINT AS matched_unique, coalesce(sum(n) FILTER (hit), 0)::BIGINT AS matched_reads, coalesce(max(n) FILTER (NOT hit), 0) AS max_unmatched,
count(*) FILTER (NOT hit)::BIGINT AS unmatched_unique, coalesce(sum(n) FILTER (NOT hit), 0)::BIGINT AS unmatched_reads
FROM (SELECT *, (sample, region, seq) IN (SELECT sample, region, seq FROM mt) AS hit FROM keep) GROUP BY sample, region""")
def q21_unmatched_stats(fx):
    return match.match_stats(fx.kept_reads, fx.matches)


@query("SELECT sample, bact_id, region, perfect::BIGINT AS perfect, round(log10(mass), 6) AS log_mass FROM ev")
def q22_perfect_counts(fx):
    return fx.each(solve.evidence(fx.lik)).select("sample", "bact_id", "region", "perfect", F.round(F.log10("mass"), 6).alias("log_mass"))


@query("SELECT * FROM kept")
def q23_division_filter(fx):
    return fx.each(fx.kept(fx.lik)).select("sample", "bact_id", "norm")


@query("""SELECT sb.sample, sb.bact_id, any_value(norm) AS norm FROM sb JOIN nrm USING (bact_id) LEFT JOIN (SELECT bact_id, region FROM fx_ref WHERE is_perfect_match) pm USING (bact_id)
LEFT JOIN (SELECT sample, bact_id, region, count(*) FILTER (d <= 1) AS near FROM lik GROUP BY ALL) ev ON ev.sample = sb.sample AND ev.bact_id = sb.bact_id AND ev.region = pm.region
WHERE norm > 0 GROUP BY sb.sample, sb.bact_id HAVING bool_and(pm.region IS NULL OR coalesce(near, 0) >= 2)""")
def q24_do_filter2(fx):
    """Two reads in each region; a bacterium has one perfect read at most here, so those one mismatch away count too."""
    near = fx.lik.withColumn("d", F.greatest(F.col("d") - 1, F.lit(0)))
    return fx.each(fx.kept(near, AlgoConfig(do_filter=2, num_reads_matched=2))).select("sample", "bact_id", "norm")


@query("SELECT sample, representative, count(*)::BIGINT AS n_members, md5(string_agg(bact_id, ',' ORDER BY bact_id)) AS hash FROM grp GROUP BY ALL")
def q25_ambiguity_groups(fx):
    return fx.groups.groupBy("sample", "representative").agg(F.count("*").alias("n_members"), hashing.members_hash(F.collect_list("bact_id")).alias("hash"))


_PARTS = "SELECT concat('S', p_partkey % 3) AS sample, p_size % 5 AS region, p_brand AS seq, p_partkey % 400 AS col FROM part"


@query(f"""WITH s AS (SELECT DISTINCT * FROM ({_PARTS})), nz AS (SELECT sample, col, count(*) AS nnz FROM s GROUP BY ALL)
SELECT DISTINCT p.sample, p.i AS col FROM (SELECT a.sample, a.col AS i, b.col AS j, count(*) AS c FROM s a JOIN s b ON a.sample = b.sample AND a.region = b.region AND a.seq = b.seq AND a.col <> b.col GROUP BY ALL) p
JOIN nz x ON x.sample = p.sample AND x.col = p.i JOIN nz y ON y.sample = p.sample AND y.col = p.j WHERE c = x.nnz AND y.nnz > x.nnz""", False)  # fmt: skip
def q26_inclusion_filter(fx):
    p = F.col("p_partkey")
    rows = fx.table("part").select(
        F.concat(F.lit("S"), (p % 3).cast("string")).alias("sample"), (F.col("p_size") % 5).alias("region"), F.col("p_brand").alias("seq"), (p % 400).alias("col")
    )
    return solve.included(rows.distinct())


@query("SELECT sample, region, seq, col, round(log10(a), 6) AS log_a, round(y, 9) AS y FROM sy")
def q27_system_assembly(fx):
    return fx.system.select("sample", "region", "seq", "col", F.round(F.log10("a"), 6).alias("log_a"), F.round("y", 9).alias("y"))


@query("SELECT sample, col, round(x, 7) AS x FROM x0")
def q28_em_init(fx):
    return solve.em_init(fx.system).withColumn("x", F.round("x", 7))


@query("SELECT sample, col, round(x, 7) AS x FROM x3")
def q29_em_step3(fx):
    system = fx.system
    x = solve.em_init(system)
    for _ in range(3):
        x = solve.em_step(system, x)
    return x.withColumn("x", F.round("x", 7))


def _recursive(cfg: AlgoConfig) -> str:
    """``em``: every update of every sample up to the one that meets the tolerance, which is marked ``done``."""
    prune = f"WHERE NOT (NOT done AND step % {cfg.prune_every} = 0 AND x < {cfg.zero!r})" if cfg.prune_every else ""
    return f"""em AS (SELECT sample, col, x, 0 AS step, false AS done FROM x0 UNION ALL
SELECT * FROM (SELECT sample, col, x, step, sum(e) OVER (PARTITION BY sample) < {cfg.tol!r} OR step = {cfg.num_iter} AS done FROM (
  SELECT sample, col, any_value(x) * sum(a * y / (t + 2.220446049250313e-16)) AS x, any_value(step) + 1 AS step, abs(1 - sum(a * y / (t + 2.220446049250313e-16))) * any_value(x) AS e
  FROM (SELECT sample, col, a, y, x, step, sum(a * x) OVER (PARTITION BY sample, region, seq) AS t FROM sy JOIN em USING (sample, col) WHERE NOT done) GROUP BY sample, col)) {prune}),
solved AS (SELECT sample, col, x / sum(x) OVER (PARTITION BY sample) AS x, step AS iterations FROM em WHERE done AND x > {cfg.zero!r})"""


def recursive_query(cfg: AlgoConfig, sql: str):
    def add(f):
        query()(f)
        # every update reads the system again
        stages = STAGES.replace("sy AS (", "sy AS MATERIALIZED (")
        ORACLE[f.__name__] = f"WITH RECURSIVE {stages},\n{_recursive(cfg)}\n{sql}"
        return f

    return add


_SOLVED = "SELECT sample, col, round(x, 7) AS x, iterations FROM solved"
SPREAD = AlgoConfig(distribute_above=0)
#: A cut so high that columns of the fixture fall below it.
PRUNED = AlgoConfig(prune_every=3, zero=0.034)


@recursive_query(ALGO, "SELECT sample, col, round(x / norm / sum(x / norm) OVER (PARTITION BY sample), 6) AS freq FROM solved JOIN (SELECT DISTINCT sample, col, norm FROM sy) USING (sample, col)")
def q30_em_converged(fx):
    system = fx.system
    return solve.frequencies(solve.em(system, ALGO), system, ALGO).withColumn("freq", F.round("freq", 6))


@recursive_query(SPREAD, _SOLVED)
def q50_em_distributed(fx):
    """Each sample's rows in blocks over tasks, until it meets the tolerance."""
    return solve.em(fx.system, SPREAD).where("x > 0").withColumn("x", F.round("x", 7))


@recursive_query(PRUNED, _SOLVED)
def q51_em_compacted(fx):
    """Tiny columns leave the system every few updates."""
    return solve.em(fx.system, PRUNED).where("x > 0").withColumn("x", F.round("x", 7))


@recursive_query(replace(PRUNED, prune_every=2), _SOLVED)
def q51_em_distributed_compacted(fx):
    return mixture.solve_blocks(fx.system, replace(PRUNED, prune_every=2), block_entries=200).where("x > 0").withColumn("x", F.round("x", 7))


@query("SELECT sample, col, reads FROM asg")
def q31_read_assignment(fx):
    return solve.assigned_reads(fx.system, fx.frequencies())


@query("SELECT sample, group_id, level, path, n_members, round(fraction, 9) AS fraction, hash FROM lv2")
def q32_taxa_levels(fx):
    return taxonomy.levels(fx.members, fx.taxonomy).select("sample", "group_id", "level", _path().alias("path"), "n_members", F.round("fraction", 9).alias("fraction"), "hash")


@query("SELECT sample, group_id, path, round(freq, 7) AS freq, reads FROM top")
def q33_majority_lineage(fx):
    return fx.top.select("sample", "group_id", _path().alias("path"), F.round("freq", 7).alias("freq"), "reads")


@query("SELECT sample, group_id, level, path, round(freq * fraction, 7) AS freq, round(reads * fraction)::BIGINT AS reads FROM lv2 JOIN fnd USING (sample, group_id)")
def q33_soft_split(fx):
    out = taxonomy.soft_split(taxonomy.levels(fx.members, fx.taxonomy), fx.found)
    return out.withColumns({"path": _path(), "freq": F.round("freq", 7)})


_SAMPLES = ["S0", "S1", "S2", "S3"]


@query("SELECT path, " + ", ".join(f"round(coalesce(sum(freq) FILTER (sample = '{s}'), 0), 7) AS \"{s}\"" for s in _SAMPLES) + " FROM tx GROUP BY path")
def q34_taxa_pivot(fx):
    wide = report.pivot(report.taxa(fx.top, ReportConfig()), _SAMPLES)
    return wide.select(_path().alias("path"), *(F.round(s, 7).alias(s) for s in _SAMPLES))


def _catalog(fx):
    ids = fx.table("part").select(F.col("p_partkey").alias("bact_id"))
    return ids.withColumn("headers", F.array(F.col("bact_id").cast("double"), (F.col("bact_id") % 7) + (F.col("bact_id") % 3) / 1000))


_SOURCES = """hd AS (SELECT sample, representative AS group_id, unnest([bact_id::DOUBLE, bact_id % 7 + (bact_id % 3) / 1000]) AS h FROM grp),
hn AS (SELECT sample, group_id, count(DISTINCT floor(h)) AS n FROM hd GROUP BY ALL)"""


@query(None)
def q35_weighted_sources(fx):
    out = report.mean_sources(fx.top, report.group_sources(fx.members, _catalog(fx)))
    return out.select("sample", _path().alias("path"), F.round("mean_sources", 6).alias("mean_sources"))


ORACLE["q35_weighted_sources"] = f"WITH {STAGES}, {_SOURCES} SELECT sample, path, round(sum(freq * n) / (sum(freq) + 2.220446049250313e-16), 6) AS mean_sources FROM top JOIN hn USING (sample, group_id) GROUP BY ALL"


@query("""SELECT sample, group_id, freq, passed FROM (SELECT sample, group_id, round(freq, 7) AS freq,
coalesce(sum(freq) OVER (PARTITION BY sample ORDER BY freq DESC, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 0.5 AS passed FROM fnd WHERE freq >= 0.01)""")
def q36_cum_mass_cut(fx):
    out = report.mark_passed(fx.found, ReportConfig(min_freq=0.01, cut_freq_th=0.5))
    return out.select("sample", "group_id", F.round("freq", 7).alias("freq"), "passed")


@query("SELECT sample, path, round(freq * t)::BIGINT AS \"count\" FROM tx JOIN (SELECT sample, sum(reads) AS t FROM top GROUP BY ALL) USING (sample)")
def q37_counts_report(fx):
    top = fx.top
    out = report.counts(report.taxa(top, ReportConfig()), report.totals(top, top.select("sample").distinct()))
    return out.withColumn("path", _path())


@query("""SELECT DISTINCT replace(concat('k__', domain, ';p__', phylum, ';c__', class, ';o__', "order", ';f__', family, ';g__', genus, ';s__', species), ' ', '_') AS name FROM fx_taxonomy""")
def q38_lineage_names(fx):
    return taxonomy.paths(fx.taxonomy).select(report.lineage_name(F.col("path")).alias("name")).distinct()


_FUNNEL = """g AS (SELECT sample, count(*) AS loaded, count(*) FILTER (is_long) AS long, count(*) FILTER (is_long AND is_good) AS good FROM qc GROUP BY ALL),
h AS (SELECT *, (sample, region, seq) IN (SELECT sample, region, seq FROM mt) AS hit FROM keep),
st AS (SELECT sample, 'Number of loaded reads' AS metric, NULL::INT AS region, loaded AS n_reads FROM g UNION ALL SELECT sample, 'Number of long reads', NULL, long FROM g UNION ALL SELECT sample, 'Number of good reads', NULL, good FROM g
 UNION ALL SELECT sample, 'Number of reads mapped to region', region, sum(n) FROM reg2 GROUP BY ALL UNION ALL SELECT sample, 'After low abundance filter', region, sum(n) FROM keep GROUP BY ALL
 UNION ALL SELECT sample, 'Number of reads mathced to DB', region, coalesce(sum(n) FILTER (hit), 0) FROM h GROUP BY ALL UNION ALL SELECT sample, 'Count of maximal unmatched read', region, coalesce(max(n) FILTER (NOT hit), 0) FROM h GROUP BY ALL
 UNION ALL SELECT sample, 'Count of all unmatched read', region, coalesce(sum(n) FILTER (NOT hit), 0) FROM h GROUP BY ALL)"""


@query()
def q39_stats_funnel(fx):
    reads, kept, found = fx.region_reads, fx.kept_reads, fx.matches
    out = stats.funnel_stats(fx.spark, qc.counts(fx.reads, PREP), regions.totals(reads), regions.totals(kept), match.match_stats(kept, found)).rows
    return report.funnel(out)


ORACLE["q39_stats_funnel"] = (
    f"WITH {STAGES}, {_FUNNEL} SELECT sample, "
    + ", ".join(
        f"max(n_reads) FILTER (metric = '{m}' AND region {'IS NULL' if r is None else f'= {r}'})::BIGINT AS \"{m if r is None else f'{m} {r}'}\""
        for m, r in [(m, None) for m in report.GLOBAL_METRICS] + [(m, r) for r in (1, 2, 3, 4, 5) for m in report.REGION_METRICS]
    )
    + " FROM st GROUP BY sample"
)


@query("SELECT p_brand AS brand, md5(string_agg(p_partkey, ',' ORDER BY p_partkey)) AS hash FROM part GROUP BY p_brand", False)
def q40_group_hash(fx):
    return fx.table("part").groupBy(F.col("p_brand").alias("brand")).agg(hashing.members_hash(F.collect_list("p_partkey")).alias("hash"))


@query("""SELECT p_partkey AS id, md5(p_name) AS md5, upper(md5(p_name)) AS upper_md5, sha1(p_name) AS sha1, sha256(p_name) AS sha256, rtrim(base64(unhex(md5(p_name))), '=') AS b64 FROM part""", False)
def q41_digests(fx):
    b = F.encode("p_name", "ISO-8859-1")
    d = hashing.digest_column
    return fx.table("part").select(
        F.col("p_partkey").alias("id"), d(b).alias("md5"), d(b, "md5", "HEX").alias("upper_md5"), d(b, "sha-1").alias("sha1"), d(b, "sha-256").alias("sha256"), d(b, "md5", "base64").alias("b64")
    )


@query()
def q41_wide_digests(fx):
    b = hashing.text_bytes(F.col("p_name"))
    d = hashing.digest_column
    return fx.table("part").select("p_partkey", d(b, "sha-384", "base64").alias("sha384"), d(b, "sha-512").alias("sha512"), d(b, "md5", "uint8").alias("bytes"))


@query("SELECT DISTINCT p_brand AS brand, replace(replace(p_brand, 'Brand', 'Assigned'), 'Assigned', 'Unknown') AS name FROM part", False)
def q42_rename_unknown(fx):
    b = fx.table("part").select(F.col("p_brand").alias("brand")).distinct()
    return b.select("brand", report.renamed(F.array(F.replace("brand", F.lit("Brand"), F.lit("Assigned"))))[0].alias("name"))


@query("""SELECT bact_id, region, kmer, round(1.0 / count(*) OVER (PARTITION BY bact_id, region), 6)::DOUBLE AS weight
FROM (SELECT DISTINCT bact_id, region, kmer FROM (SELECT bact_id, region, substr(kmer, 1, 20) AS kmer FROM fx_ref WHERE kmer IS NOT NULL UNION ALL SELECT bact_id, region, substr(kmer, 21) FROM fx_ref WHERE kmer IS NOT NULL))""")
def q43_se_incidence(fx):
    return refdb.halves(fx.ref, 20).select("bact_id", "region", "kmer", F.round("weight", 6).alias("weight"))


@query("""SELECT sample, r1, r2, lpad(CAST(row_number() OVER (PARTITION BY sample ORDER BY r1, r2) AS VARCHAR), length(CAST(count(*) OVER (PARTITION BY sample) AS VARCHAR))::INT, '0') AS header FROM uni""")
def q44_header_format(fx):
    return sinks.numbered(fx.uni).select("sample", "r1", "r2", "header")


@query("SELECT concat_ws(chr(9), path, " + ", ".join(f"printf('%.6f', round(coalesce(sum(freq) FILTER (sample = '{s}'), 0), 6))" for s in _SAMPLES) + ") AS line FROM tx GROUP BY path")
def q45_tsv_render(fx):
    wide = report.pivot(report.taxa(fx.top, ReportConfig()), _SAMPLES)
    cols = [_path(), *(F.round(s, 6) for s in _SAMPLES)]
    return wide.select(report.line_column(cols, ["string"] + ["double"] * 4).alias("line"))


@query("SELECT sample, sum(reads)::BIGINT AS reads FROM top GROUP BY sample")
def q46_totals_row(fx):
    top = fx.top
    return report.totals(top, fx.reads.select("sample").distinct())


@query("SELECT sample, sum(reads)::BIGINT AS reads FROM top GROUP BY sample UNION ALL SELECT 'empty', 0")
def q46_empty_sample(fx):
    samples = fx.reads.select("sample").distinct().unionByName(fx.spark.range(1).select(F.lit("empty").alias("sample")))
    return report.totals(fx.top, samples)


@query("""SELECT p_brand AS brand, count(*)::INT AS n_headers, count(DISTINCT floor(h))::INT AS n_sources FROM (SELECT p_brand, unnest([p_partkey::DOUBLE, p_partkey % 7 + (p_partkey % 3) / 1000]) AS h FROM part) GROUP BY p_brand""", False)
def q47_fractional_headers(fx):
    brands = fx.table("part").select(F.lit("S").alias("sample"), F.col("p_brand").alias("group_id"), F.col("p_partkey").alias("bact_id"))
    out = report.group_sources(brands, _catalog(fx))
    n = F.size(F.array_distinct(F.transform("headers", lambda h: F.floor(h))))
    return out.select(F.col("group_id").alias("brand"), F.size("headers").alias("n_headers"), n.alias("n_sources"))


@query("SELECT sample, count(*) FILTER (nnz % 2 = 1)::BIGINT AS odd, count(*)::BIGINT AS columns FROM nz GROUP BY sample")
def q48_odd_support(fx):
    return solve.odd_supports(solve.supports(fx.lik, fx.groups))


@query("""SELECT sample, representative, amplified FROM (SELECT DISTINCT sample, representative FROM grp) g
JOIN (SELECT bact_id, string_agg(CASE WHEN kmer IS NULL THEN '0' ELSE '1' END, '' ORDER BY region) AS amplified FROM fx_ref GROUP BY bact_id) r ON r.bact_id = representative""")
def q49_group_regions(fx):
    flags = F.array_join(F.transform("amplified", lambda a: a.cast("int").cast("string")), "")
    return solve.amplified_regions(fx.groups, fx.ref).withColumn("amplified", flags)


@query("SELECT * FROM uni")
def q52_incremental_uniques(fx):
    """Three batches, as of lanes, join a store one after another; it holds what one run over all gives."""
    store = additive.UniqueStore(fx.spark, own_path(fx.spark, "unique-store"))
    lane = F.pmod(F.crc32(F.col("pair_key").cast("binary")), F.lit(3))
    for k in range(3):
        store.add([f"lane {k}"], fx.reads.where(lane == k), PREP)
        if k == 1:
            store.compact()
    return qc.tally_uniques(store.tally())


@query("SELECT sample, count(*)::BIGINT AS loaded, count(*) FILTER (is_long)::BIGINT AS long, count(*) FILTER (is_long AND is_good)::BIGINT AS good FROM qc GROUP BY sample")
def q52_tally_counts(fx):
    """Read counts from the tally that unique reads come from too."""
    return qc.tally_counts(qc.tally(fx.reads, PREP), PREP)


@query("SELECT sample, concat(sample, '_L001_R1_001.fastq') AS pair_key, row_number() OVER (PARTITION BY sample ORDER BY pair_key, s1, q1, s2, q2) - 1 AS record_no, pair_key AS h1, s1, q1, pair_key AS h2, s2, q2 FROM fx_reads")
def q53_split_files(fx):
    """The fixture as a pair of FASTQ files a sample, read in ranges of some kilobytes."""
    path, order = own_path(fx.spark, "fastq"), ("pair_key", "s1", "q1", "s2", "q2")
    mates = fx.reads.repartitionByRange("sample", *order).withColumn("mate", F.explode(F.array(F.lit(1), F.lit(2))))
    of = lambda c: F.coalesce(F.when(F.col("mate") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}2")), F.lit("null"))
    record = F.concat(F.lit("@"), F.coalesce("pair_key", F.lit("null")), F.lit("\n"), of("s"), F.lit("\n+\n"), of("q"))
    rows = mates.sortWithinPartitions("sample", "mate", *order).select("sample", "mate", record.alias("value"))
    sinks.write_named_text(rows, path, ["sample", "mate"], lambda sample, mate: f"{sample}/{sample}_L001_R{mate}_001.fastq")
    return splits.read_files(fx.spark, path, range_bytes=100_000)


_WARM = """rm AS (SELECT sample, col AS gone FROM x2),
w0 AS (SELECT sample, gone, col, x / sum(x) OVER (PARTITION BY sample, gone) AS x FROM rm JOIN x2 USING (sample) WHERE col <> gone)"""


def _warm_step(k: int) -> str:
    return f"""w{k + 1} AS (SELECT sample, gone, col, any_value(x) * sum(a * y / (t + 2.220446049250313e-16)) AS x FROM (
  SELECT sample, gone, col, a, y, x, sum(a * x) OVER (PARTITION BY sample, gone, region, seq) AS t FROM sy JOIN w{k} USING (sample, col)) GROUP BY sample, gone, col)"""


@query()
def q54_leave_one_out(fx):
    """The log-likelihood without each column, two updates from where the others stood."""
    x = solve.em_init(fx.system)
    for _ in range(2):
        x = solve.em_step(fx.system, x)
    out = mixture.likelihood_without(fx.system, stage(x, "warm"), AlgoConfig(num_iter=2, tol=0.0), per_task=4)
    return out.withColumn("loglik", F.round("loglik", 6))


ORACLE["q54_leave_one_out"] = f"""WITH {STAGES}, {_WARM}, {_warm_step(0)}, {_warm_step(1)},
wf AS (SELECT sample, gone, col, x / sum(x) OVER (PARTITION BY sample, gone) AS x FROM w2 WHERE x > 1e-10),
th AS (SELECT sample, gone, region, seq, sum(a * x) AS t FROM sy JOIN wf USING (sample, col) GROUP BY ALL),
rw AS (SELECT DISTINCT sample, region, seq, y FROM sy)
SELECT sample, gone AS col, round(sum(y * ln(coalesce(t, 0) + 2.220446049250313e-16)), 6) AS loglik FROM rm JOIN rw USING (sample) LEFT JOIN th USING (sample, gone, region, seq) GROUP BY sample, gone"""


def _augment_round(k: int, limit: int) -> str:
    """Reads not near an older k-mer, against the newest."""
    newest = "km" if k == 0 else f"nw{k - 1}"
    known = " UNION ALL ".join(["SELECT region, kmer_id FROM km", *(f"SELECT region, kmer_id FROM nw{i}" for i in range(k))])
    of = " UNION ALL ".join(["SELECT bact_id, region, kmer_id FROM bk", *(f"SELECT bact_id, region, kmer_id FROM bo{i}" for i in range(k))])
    settled = " ".join(f"AND (region, seq) NOT IN (SELECT region, seq FROM nr{i})" for i in range(k))
    return f"""nr{k} AS (SELECT region, seq, kmer_id, hamming(seq, kmer) AS d FROM frq JOIN {newest} USING (region) WHERE length(seq) = length(kmer) AND hamming(seq, kmer) <= {limit} {settled}),
bs{k} AS (SELECT region, seq, min(d) AS d FROM nr{k} GROUP BY ALL),
nw{k} AS (SELECT region, seq AS kmer, top + row_number() OVER (PARTITION BY region ORDER BY seq) AS kmer_id FROM bs{k} JOIN (SELECT region, max(kmer_id) AS top FROM ({known}) GROUP BY region) USING (region) WHERE d > 0),
bo{k} AS (SELECT DISTINCT bact_id, region, nw{k}.kmer_id FROM nr{k} JOIN bs{k} USING (region, seq, d) JOIN nw{k} ON nw{k}.region = nr{k}.region AND nw{k}.kmer = nr{k}.seq
  JOIN ({of}) o ON o.region = nr{k}.region AND o.kmer_id = nr{k}.kmer_id) """.replace("SELECT DISTINCT bact_id, region,", f"SELECT DISTINCT bact_id, nr{k}.region,")


@query()
def q55_augmented_reference(fx):
    """Frequent reads one mismatch away join the reference, then those one away from them."""
    of = refdb.bact_kmers(fx.least, fx.kmers)
    known, grown = refdb.augment(fx.kept_reads, fx.kmers, of, ALGO, MAX_LEN, least=2, limit=1, rounds=3)
    members = fx.classes.groupBy(F.col("class_id").alias("bact_id")).agg(F.count("*").alias("n"), F.sum("bact_id").alias("ids"))
    sums = grown.join(large(members), "bact_id").groupBy("region", "kmer_id").agg(F.sum("n").alias("n_bact"), F.sum("ids").alias("sum_bact"))
    return known.join(sums, ["region", "kmer_id"])


ORACLE["q55_augmented_reference"] = f"""WITH {STAGES}, frq AS (SELECT DISTINCT region, seq FROM keep WHERE n > 2),
{_augment_round(0, 1)}, {_augment_round(1, 1)}, {_augment_round(2, 1)}
SELECT region, kmer_id::INT AS kmer_id, kmer, count(*)::BIGINT AS n_bact, sum(bact_id)::BIGINT AS sum_bact
FROM (SELECT * FROM km UNION ALL SELECT region, kmer, kmer_id FROM nw0 UNION ALL SELECT region, kmer, kmer_id FROM nw1 UNION ALL SELECT region, kmer, kmer_id FROM nw2)
JOIN (SELECT * FROM bk UNION ALL SELECT * FROM bo0 UNION ALL SELECT * FROM bo1 UNION ALL SELECT * FROM bo2) USING (region, kmer_id) GROUP BY ALL"""


@query("""SELECT sample, 'loaded' AS metric, 0 AS region, -1::BIGINT AS n_unique, count(*)::BIGINT AS n_reads FROM qc GROUP BY sample
UNION ALL SELECT sample, 'loaded', 0, -1, count(*) FILTER (is_long AND is_good) FROM qc GROUP BY sample
UNION ALL SELECT coalesce(k.sample, r.sample), 'in region', coalesce(k.region, r.region), coalesce(k.u, r.u), coalesce(k.n, r.n)
FROM (SELECT sample, region, count(*) AS u, sum(n)::BIGINT AS n FROM reg2 GROUP BY ALL) r FULL JOIN (SELECT sample, region, count(*) AS u, sum(n)::BIGINT AS n FROM keep WHERE region > 2 GROUP BY ALL) k ON k.sample = r.sample AND k.region = r.region""")
def q56_stats_upsert(fx):
    """Global counts append; regional ones replace those of their name and region."""
    sizes, counted = regions.totals(fx.region_reads), qc.counts(fx.reads, PREP)
    table = stats.ReadStats.empty(fx.spark).add("loaded", counted, None, "loaded").add("loaded", counted, None, "good")
    table = table.add("in region", sizes, "n_unique", "n_reads", "region")
    return table.add("in region", regions.totals(fx.kept_reads).where("region > 2"), "n_unique", "n_reads", "region").rows.na.fill({"region": 0, "n_unique": -1})


def _laid_out(fx: Fixture) -> match.Catalogue:
    """The fixture's reference, bucketed in the shared folder."""
    path = own_path(fx.spark, "catalogue")
    buckets = max(8, int(fx.spark.conf.get("spark.sql.shuffle.partitions")))
    return match.Catalogue.write(fx.kmers, refdb.bact_kmers(fx.least, fx.kmers), "fx_" + path.rsplit("-", 1)[1], path, ALGO, MAX_LEN, buckets)


@query("SELECT sample, region, seq, n, kmer_id::INT AS kmer_id, d FROM mt")
def q58_match_laid_out(fx):
    """Matches against a reference that is bucketed by its keys and not shuffled."""
    return _laid_out(fx).matches(fx.kept_reads).drop("kmer")


@query("SELECT sample, region, seq, bact_id, d, len::INT AS len, round(log10(p), 6) AS log_p FROM lik")
def q58_likelihood_laid_out(fx):
    known = _laid_out(fx)
    lik = known.likelihoods(known.matches(fx.kept_reads), ALGO)
    return fx.each(lik).select("sample", "region", "seq", "bact_id", "d", "len", F.round(F.log10("p"), 6).alias("log_p"))


ENDS = PrepConfig(read_len=K, paired=False, either_end=True)


@query(f"""SELECT sample, region, CASE WHEN dr <= 2 THEN substr(r1, 1, length(r1) - length(rev)) ELSE substr(r1, length(fwd) + 1) END AS seq, CASE WHEN dr <= 2 THEN -1 ELSE 1 END::INT AS side, sum(n)::BIGINT AS n
FROM (SELECT e.*, p.region, p.fwd, p.rev, (SELECT min(hamming(substr(e.r1, 1, length(v)), v)) FROM fv WHERE fv.region = p.region) AS df, (SELECT min(hamming(right(e.r1, length(v)), v)) FROM rv WHERE rv.region = p.region) AS dr
  FROM (SELECT sample, r1, count(*) AS n FROM (SELECT sample, r1 FROM good UNION ALL SELECT sample, {fixture.rc('r2')} FROM good) GROUP BY ALL) e CROSS JOIN fx_primers p)
WHERE dr <= 2 OR df <= 2 GROUP BY ALL""")
def q57_either_end(fx):
    """Single reads, the second mates turned round, routed by the primer that they begin or end with."""
    good = qc.good_reads(fx.reads, PREP)
    ends = good.select("sample", F.explode(F.array("r1", dna.revcomp(F.col("r2")))).alias("r1"), F.lit("").alias("r2"))
    return regions.collapse(regions.assign(qc.unique_reads(ends), ENDS))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read funnel of every sample."""
    return QUERIES["q39_stats_funnel"](spark, sf_dir)
