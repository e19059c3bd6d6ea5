"""Operators that prepare training data for language models.

Nothing outside this subpackage imports it.  ``cellmesh.llm.queries`` holds the
registered queries and their SQL; one module holds each operator.
"""
