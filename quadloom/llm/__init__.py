"""Operators of a training-data pipeline: packing, counting, cleaning, joining and writing text corpora.

Nothing else in the library imports this subpackage.
"""
