"""Offer ranking on Spark: histories, features, scores, top-k lists and their evaluation."""
