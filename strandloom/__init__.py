"""Spark-native community profiling of multi-amplicon sequencing data."""
