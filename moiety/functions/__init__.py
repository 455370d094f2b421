"""Chemistry and graphs in plain Python: no Spark here, so executors import little."""
