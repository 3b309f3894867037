"""Rule-driven text ETL, ranked search and corpus preparation as Spark jobs."""
