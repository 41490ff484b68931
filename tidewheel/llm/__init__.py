"""Operators for preparing language-model training data.

Ten operators, each a module with its own general interface; ``queries`` holds
the thin registered queries and ``oracle`` their SQL.  Nothing outside this
subpackage imports it.
"""
