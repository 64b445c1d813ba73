"""Where tables come from and where durable exchanges go."""
