"""helixframe: alignment-free sequence comparison and corpus preparation as Spark jobs."""
