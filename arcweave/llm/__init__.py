"""Operators of a training-data pipeline over text, page and label tables.

Each module is one operator; ``queries`` holds the registered queries and their SQL.
"""
