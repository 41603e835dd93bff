"""scriptorium: a Spark-native engine for analysing collections of Latin text.

Every capability is a function from DataFrames to DataFrames; Catalyst picks the physical plan.
"""

__version__ = "0.1.0"
