"""Readers: parquet test tables, separated text, gzip, Hive tables, feeds."""
