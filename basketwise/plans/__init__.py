"""End-to-end jobs: ingest, and the three trainings with their stored results."""
