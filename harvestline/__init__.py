"""Price analytics and document question answering as Spark jobs."""
