"""Operators for preparing training data at corpus scale.

Every module holds one operator and the query that applies it to a whole table; ``registry`` lists the queries.
Nothing outside this folder imports it.
"""
