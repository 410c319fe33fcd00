"""Training-data operators over the ``documents`` family of tables.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
