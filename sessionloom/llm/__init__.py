"""Training-data operators: ten Spark operators plus the queries that apply them.

Nothing outside this subpackage imports it; ``registry`` lists the queries.
"""
