"""tideline: a Spark-native engine for point-in-time, event-time and market-bar data.

Operators take and return DataFrames. ``functions`` holds Column helpers,
``operators`` relational building blocks, ``sources`` readers and writers,
``streaming`` stateful operators and ``plans`` the registered queries.
"""
