"""Forecasters fitted on Spark and the studies built on them."""
