"""Column expressions shared by the jobs."""
