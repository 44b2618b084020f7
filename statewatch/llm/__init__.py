"""Operators for preparing language-model training text, kept apart from the rest of the library.

Nothing outside this folder imports it. Each module holds one operator; ``queries`` maps the shared
tables to the operators and back.
"""
