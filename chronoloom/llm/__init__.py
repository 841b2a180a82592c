"""Training-data operators: ten Spark operators for corpus preparation.

Nothing outside this folder imports it, apart from the guarded lookups in
``__spark_entry__.py`` and the pipeline file at the top of the repository.
"""
