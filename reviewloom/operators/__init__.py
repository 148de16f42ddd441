"""Operators on reviews, units, edges and scores."""
