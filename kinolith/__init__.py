"""kinolith: corpus building, auditing and scoring of structured sequence data on Spark."""
