"""Programs over the operators: dataset preparation, the round driver and the query catalogue."""
