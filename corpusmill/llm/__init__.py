"""Operators for preparing training data at scale.

Every module holds one operator with a general interface and, where one is
registered, the thin query that derives a digest from the operator's rows.
Nothing outside this subpackage imports it.
"""
