"""Readers and writers: delimited files, staged tables, order tables and fitted models."""
