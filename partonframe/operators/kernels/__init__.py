"""Clustering of one event, in numpy alone."""
