"""spandrel: usage analytics over source-code corpora, declared as Spark plans."""
