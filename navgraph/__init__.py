"""navgraph: link-navigation analytics and corpus preparation as Spark jobs."""
