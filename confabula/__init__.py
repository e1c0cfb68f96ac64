"""Conversation analytics on Spark: set-oriented DataFrame operators over chat tables."""
