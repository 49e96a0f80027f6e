"""corpusflow: retrieval, ingestion, citation and trace analytics over document libraries, as Spark plans."""
