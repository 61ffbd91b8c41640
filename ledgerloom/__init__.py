"""Account-ledger analytics on Spark: DataFrame operators, plans and query registry."""
