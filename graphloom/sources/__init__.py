"""Readers and writers: graph files, edge lists, logs, dumps."""
