"""Clustering models and their scores."""
