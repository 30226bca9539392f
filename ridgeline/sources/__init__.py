"""Readers and writers of ratings, predictions and factor tables."""
