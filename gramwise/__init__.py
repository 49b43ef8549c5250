"""Applied regression analytics as Spark jobs."""
