"""Operators that prepare training text: thirteen methods, each a Spark job.

Nothing outside this subpackage imports it.
"""
