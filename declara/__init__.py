"""declara: declarative data projects on Spark."""
