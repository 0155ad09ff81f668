"""sumizh: cooperation analytics over municipalities, expressed as Spark plans.

Every operator is a function from DataFrames to a DataFrame.  ``sources`` reads,
``functions`` holds column expressions, ``operators`` the dataflow operations,
``plans`` the named queries with their SQL, ``streaming`` the incremental forms
and ``llm`` the operations on training data (an optional part).
"""
