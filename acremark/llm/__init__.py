"""Operators on the texts of the land-analysis records: preparing them as language-model training data.

Each module holds one operator in terms of the project's records (analysis lists with their
descriptions, map features with their tags, bus artifacts with their payloads). ``queries`` maps the
given tables to these interfaces. Nothing outside this package imports it.
"""
