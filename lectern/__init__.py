"""Document retrieval and coverage analytics as DataFrame jobs."""
