"""Tidemark: measurement and evidence operators for PySpark.

Answers "what changed, and how strong is the evidence" over large metric and
web-search tables. Every operator is a function from DataFrames to a
DataFrame; nothing is collected on the driver inside an operator.
"""
