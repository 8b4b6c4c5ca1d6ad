"""Readers and writers; every path may be any file system Spark can reach."""
