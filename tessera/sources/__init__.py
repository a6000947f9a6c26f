"""Readers and writers of scans, calibrations, images, segments, costs, matrices and models.

Binary layouts are parsed from Spark's ``binaryFile`` source in Arrow batches, so any file system that
Spark reads will do; tables are Parquet.
"""
