"""riskwave: transaction-risk analytics expressed as Spark DataFrame plans.

Sub-packages:
  sources    -- table readers and the derived fixture views (transactions, requests, scores)
  functions  -- column expressions (feature engineering, bands, encodings)
  operators  -- batch operators: velocity frames, joins, aggregates, case files, metrics
  plans      -- plan-shape helpers: bounded broadcast, distributed prefix sums, lineage cuts
  streaming  -- Structured Streaming forms of the keyed operators and sinks
  ml         -- Spark ML training / scoring and tree explanations
"""

__all__ = ["session"]
