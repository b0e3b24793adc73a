"""Conversation, document and transaction-trace analytics on PySpark."""
