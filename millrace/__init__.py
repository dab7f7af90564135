"""millrace: manufacturing production analytics expressed as Spark plans.

Sub-packages:
  sources    readers, schemas, fixture mappings, sinks
  operators  cleaning, KPIs, tenancy joins/upserts, windows, models
  functions  column-expression helpers (text, bands, narratives)
  plans      composite jobs and the registered query catalogue
  streaming  Structured Streaming ingest and live KPIs
"""

__version__ = "0.1.0"
