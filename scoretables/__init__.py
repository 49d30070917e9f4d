"""Score and page-layout analytics as Spark jobs over tables."""
