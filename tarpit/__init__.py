"""tarpit — honeypot-session analytics on Spark.

Turns SSH-honeypot event logs into sessions, behavioural features, scores,
labels, geo/campaign enrichment and report tables, using only the DataFrame
API, Spark SQL, Spark ML and Structured Streaming.

Layout:
    sources/    readers, writers, history merge, test-table stand-in inputs
    functions/  column expressions (no UDFs): keys, IP rules, labels, bands
    operators/  DataFrame -> DataFrame transforms (sessionize, features,
                geo range join, campaigns, clustering, ML, metrics)
    plans/      composed jobs (enrich, dashboard view, reports, query catalog)
    streaming/  Structured Streaming sessionizer and incremental runner
"""

__version__ = "0.1.0"
