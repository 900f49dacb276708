"""tidemark: item catalogues, similarity ranking and corpus preparation as Spark jobs."""
