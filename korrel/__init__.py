"""korrel: knowledge-graph retrieval, its evaluation and corpus preparation as Spark jobs."""
