"""Event-log flow analytics on Spark: enrichment, ledgers, absorbing chains, as-of calls."""
