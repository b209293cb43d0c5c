"""Operators of a training-data pipeline: one module each, plus their registered queries.

Nothing outside this folder imports it. ``queries`` holds the registered
queries, ``oracle`` their SQL twins where SQL can say the same.
"""
