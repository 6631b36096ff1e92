"""Spark jobs for behaviour logs, places, dialogues, records and text corpora."""
