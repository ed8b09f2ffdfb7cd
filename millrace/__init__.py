"""millrace: agent-session telemetry, event spools and skill documents as Spark DataFrames."""
