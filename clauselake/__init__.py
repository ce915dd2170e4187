"""Document retrieval and question-answering analytics on Spark."""
