"""logloom: log analytics and corpus operators as Spark plans."""
