"""Registered queries: each Spark plan beside the SQL that gives the same rows."""

MODULES = ("reviews", "edges", "scores", "models", "pieces", "sampled", "graphs", "files", "similar", "profiled", "roles", "streams", "governance")
