"""topicloom: topic and market intelligence over short texts, as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame (or builds a Column), and
carries ``topic`` as a grouping key, so one job covers a whole corpus of topics.
"""

__version__ = "0.1.0"
