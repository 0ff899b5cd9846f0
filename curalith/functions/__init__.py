"""Column functions: text, numbers, vocabulary, signals and pitch."""
