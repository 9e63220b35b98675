"""Document analytics over tables of texts, written as Spark DataFrame jobs."""
