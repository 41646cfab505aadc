"""adlens: sponsored-search campaign analytics on Spark.

Sub-packages: ``sources`` (record parsing, typed inputs), ``functions``
(column expressions), ``operators`` (keyword, clustering, feature,
regression, tree-model and request-log operators), ``plans`` (end-to-end
flows, registered queries, DuckDB oracles) and ``streaming``.
"""

__version__ = "0.1.0"
