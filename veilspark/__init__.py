"""Secret and personal-data detection and redaction as Spark plans."""
