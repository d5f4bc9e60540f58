"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames, selects the columns it needs by name (so further columns, whatever
they are called, pass it by) and keeps intermediate tables in the shared folder
named by ``spark.checkpoint.dir``.
"""
