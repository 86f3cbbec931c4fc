"""rankfold — implicit-feedback recommendation analytics as Spark DataFrame jobs.

Sub-packages:
  sources    readers/writers (events, properties, bundles, reports, run log)
  functions  reusable Column expressions (weights, ids, buckets, clipping)
  operators  DataFrame -> DataFrame operators (prepare, split, features, models,
             recommend, evaluate, quality, fairness, rerank, explain, telemetry)
  streaming  Structured Streaming versions of the stream-capable operators
  plans      the registered queries over the driver's test tables + training flow
"""

from rankfold.config import Settings, DEFAULTS  # noqa: F401
