"""Loomspan: web-content analytics and crawl set algebra on Spark DataFrames."""
