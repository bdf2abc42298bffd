"""Relational steps of corpus preparation, splitting, selection and evaluation."""
