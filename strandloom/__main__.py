"""Command line: ``python -m strandloom READS_DIR DB_DIR DB_NAME RESULTS [KMER_LEN] [GROUP_RESULTS]``."""

import argparse

from pyspark.sql import SparkSession

from strandloom.plans.profile import run


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="strandloom")
    for name in ("reads_dir", "db_dir", "db_name", "results"):
        p.add_argument(name)
    p.add_argument("kmer_len", nargs="?", type=int, default=100)
    p.add_argument("group_results", nargs="?", type=int, default=0)
    p.add_argument("--flat", action="store_true", help="one folder holds the files of all samples")
    p.add_argument("--store", help="a store of unique reads: only files that it has not are read")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    for name, path in run(spark, a.reads_dir, a.db_dir, a.db_name, a.results, a.kmer_len, bool(a.group_results), flat=a.flat, store=a.store).items():
        print(name, path)


if __name__ == "__main__":
    main()
