"""DataFrame operators: exchanges, combining, ordering, integrity and what Spark carries on top."""
