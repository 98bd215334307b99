"""codeloom: code-corpus analytics on Spark.

Source files become symbol, snippet and property-graph tables; batches of
issues are answered with keyword, vector and hybrid top-k search plus graph
neighbourhood queries; candidate patches are extracted, scored and ranked.
Every step is a DataFrame job keyed by snapshot and issue.
"""

__version__ = "0.1.0"
