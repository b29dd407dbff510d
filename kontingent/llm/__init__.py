"""Training-data operators: thirteen corpus operators and the queries that apply them.

Nothing else in the library imports this subpackage.  Each operator module has
a general interface (tables in, tables out, parameters as keyword arguments);
``queries`` holds the thin ``opN_*`` queries with their fixed contracts.
"""
