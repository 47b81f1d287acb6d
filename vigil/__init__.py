"""vigil: threat-intelligence text analytics as Spark DataFrame operators.

Every operator is a function from DataFrames (plus plain parameters) to a
DataFrame, so Catalyst plans the whole chain: sources -> ingestion ->
preprocessing -> indicator extraction -> classification -> correlation ->
scoring -> store -> reports and serving queries.
"""

__version__ = "0.1.0"
