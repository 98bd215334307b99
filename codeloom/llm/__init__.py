"""Training-data operators: ten operators over documents, pages and embeddings, and their queries."""
