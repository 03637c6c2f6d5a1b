"""quarry: evidence retrieval and text analytics, declared as Spark plans."""
