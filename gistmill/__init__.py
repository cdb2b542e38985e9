"""Batch skimming of document corpora on Spark."""
