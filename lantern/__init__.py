"""lantern: federated retrieval analytics on Spark.

Relational, graph and text queries over one archive, their integration into ranked contexts, and
the data-processing operators a large archive needs before it is used. Everything is a DataFrame
plan; see README.md for the layout.
"""

__version__ = "0.1.0"
