"""Operators of a training-data pipeline.

Nothing outside this folder imports it; its queries and their SQL are in
``queries.py``.
"""
