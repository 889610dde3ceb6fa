"""The jobs of the lake: each reads its source, brings its table up to date and returns the table's new state."""
