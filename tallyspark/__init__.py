"""Shop-ledger analytics on Spark: reports, text answers, data-quality checks
and guarded ledger operators for many shops at once.

Modules:

* ``tallyspark.operators.reports``  dashboard, rankings, weekly report, balances, restocking
* ``tallyspark.operators.answers``  rule-based text answers over the reports
* ``tallyspark.operators.ledger``   validation and snapshot + batch → outcomes / new snapshot
* ``tallyspark.operators.fold``     the ordered "check, then apply" fold behind sales and payments
* ``tallyspark.operators.history``  list views of tables and ledgers
* ``tallyspark.operators.tenant``   tenant scoping and row visibility
* ``tallyspark.operators.generate`` distributed demo-data generators
* ``tallyspark.sources``            driver-table reads, fixture adapters, sinks and snapshots
* ``tallyspark.streaming.ingest``   Structured Streaming ingest of stock and credit commands
* ``tallyspark.plans``              the registered queries and their DuckDB oracles

Every operator takes DataFrames holding all shops and returns a lazy
DataFrame keyed by ``shop_id``; ``today`` and ``shop_id`` are arguments.
"""
