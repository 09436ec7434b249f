"""Training-data operators: ten corpus operators, their registered queries and SQL.

Nothing outside this subpackage imports it.
"""
