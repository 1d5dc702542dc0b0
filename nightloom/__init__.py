"""Sky-background analytics and training-data operations as Spark jobs."""
