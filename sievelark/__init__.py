"""Triage of reported suspicious mail, and the text operations around it, as Spark DataFrame operators."""
