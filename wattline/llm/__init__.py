"""Training-data pipeline operators: Spark jobs over a corpus of documents and their embeddings.

Nothing else in the library imports this package; it can be deleted as a whole.
"""
