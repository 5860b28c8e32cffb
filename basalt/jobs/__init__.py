"""Jobs: scoring, monitoring, whole runs from a configuration, reports and the operations of a service."""
