"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the text-heavy ones run as Arrow batch functions whose inner loops
are numpy passes over the UTF-8 buffer of the text column (see ``_vec``).
"""
