"""Training-data operators: ten corpus operators and their queries.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries when it can be found.
"""
