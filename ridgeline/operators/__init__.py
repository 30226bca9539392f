"""Ratings quality, blocks, ALS steps, prediction and evaluation."""
