"""Models of how an exchange moves bytes: fetch plans, flush policies, sampling schedules."""
