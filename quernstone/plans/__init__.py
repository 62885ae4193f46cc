"""Plans as data: a JSON plan language, its fragments and tasks, scheduling over them, and a view of Spark's own plans."""
