"""emberquill: a Spark-native engine for evidence retrieval, ranking and catalogue data.

Every operator is a function from DataFrames to a DataFrame.  Subpackages:

* ``functions``  scalar and vector expressions
* ``operators``  relational, retrieval, scoring, evaluation and versioning operators
* ``sources``    readers and writers
* ``streaming``  windows, alerts and stateful limits
* ``plans``      end-to-end pipelines and the registry of named queries
* ``llm``        operators for text corpora; nothing outside it imports it
"""

__version__ = "0.1.0"
