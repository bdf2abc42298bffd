"""Corpus preparation and generative text classification as Spark jobs."""
