"""Local haplotype reconstruction and population analysis as Spark jobs."""
