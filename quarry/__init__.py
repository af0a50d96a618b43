"""quarry: analysing and searching a code corpus and its history with Spark."""
