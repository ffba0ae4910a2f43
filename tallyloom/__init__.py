"""Quality control of recurring deliverables as Spark jobs."""
