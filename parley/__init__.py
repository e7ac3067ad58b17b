"""Conversation, knowledge and retrieval analytics as Spark jobs."""
