"""starmill: star-schema generation, query suites and table upkeep as Spark jobs."""
