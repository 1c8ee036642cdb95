"""veilgraph: graph anonymisation, graph analytics and corpus operators as Spark jobs."""
