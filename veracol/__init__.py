"""veracol: decide whether a table can be trusted, and make it trustworthy, with Spark jobs.

The package is organised by what a caller needs:

* ``sources``   - scans, landing-file screening, row order, sinks
* ``functions`` - Column-level building blocks (text, dates, casts)
* ``operators`` - DataFrame operators: profile, checks, score, clean, fills, quantiles
* ``plans``     - composed jobs: catalogue, ingest and clean, governance mart, measures, reports
* ``streaming`` - the row-local rules applied to a streaming DataFrame
"""
