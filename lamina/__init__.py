"""lamina: layered healthcare-style analytics on plain Spark DataFrames.

Sub-packages
------------
functions   Column -> Column cleansing functions
sources     parsers, file and REST readers, load control, parquet table store
operators   DataFrame -> DataFrame operators
streaming   Structured Streaming counterparts
plans       dimensions, facts, measures and the registry of named queries
llm         text and record-linkage operators (optional; nothing else imports it)
"""
