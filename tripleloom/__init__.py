"""tripleloom: knowledge-graph triples, test-case tables and specification documents as Spark jobs.

Every operator is a plain ``DataFrame -> DataFrame`` function (or a ``Column ->
Column`` function) to be used with ``df.transform`` or ``df.select``.  Rule
tables, weights and templates are arguments.
"""
