"""Operators of a training-data pipeline over whole corpora.

Nothing outside this package imports it.  Each module holds one operator with
its own general interface; ``registry`` turns them into the thin queries
``opN_<name>`` and their SQL.
"""
