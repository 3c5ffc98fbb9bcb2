"""octolake: Spark-first analytics over biological sequence trajectories."""
