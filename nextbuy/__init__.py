"""nextbuy: next-month product recommendation on Spark DataFrames.

Layers:
  sources/    table access, stand-in fixtures, CSV readers and writers
  functions/  column expressions (cleaning, features, scaling, array metrics)
  operators/  DataFrame -> DataFrame steps (clean, impute, featurize, sequences,
              metrics, recommendations, training logs, activations, scorers)
  plans/      end-to-end flows and the registered queries
  streaming/  incremental month scan with Structured Streaming
"""

__version__ = "0.1.0"
