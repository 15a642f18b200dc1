"""spellwise: event-history and disease-free survival analytics as Spark jobs."""
