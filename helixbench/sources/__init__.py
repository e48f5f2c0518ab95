"""Readers and writers of the benchmark's file layouts."""
