"""Verified data cleaning as Spark jobs: a repair is kept only when it is proven to help."""
