"""Table operators: each takes relations and returns one, lazily."""
