"""DataFrame -> DataFrame operators of the vocabulary lake."""
