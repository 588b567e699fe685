"""Structured Streaming: resumable ingestion and stateful folds."""
