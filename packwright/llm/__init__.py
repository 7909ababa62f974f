"""Corpus operators for training-data pipelines.

Every operator takes DataFrames and column names, reads whole texts, and keeps its own column names
behind the prefix ``_pw_`` until its result is assembled, so extra input columns never clash.
"""
